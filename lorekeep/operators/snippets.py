"""Excerpts of entries for display, as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens

#: Characters of an excerpt, and words of a window.
SHOWN, BEST = 200, 12
_BLANK = "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$"


def drawn_place(hash_: str, places: Column) -> Column:
    """A place below `places` that the hash draws: its digest's first eight bytes, the lowest first, as a number."""
    hexed = F.sha2(F.col(hash_), 256)
    number = F.conv(F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in range(7, -1, -1))), 16, 10).cast("decimal(20,0)")
    return (number % places.cast("decimal(20,0)")).cast("int")


def with_excerpt(rows: DataFrame, value: str = "value", hash_: str = "hash", shown: int = SHOWN) -> DataFrame:
    """Adds snippet, about `shown` characters from a place that the hash draws, cut at spaces, with marks where text is left out. A short value is shown whole."""
    text, n = F.coalesce(F.col(value), F.lit("")), F.length(F.coalesce(F.col(value), F.lit("")))
    drawn = rows.withColumn("_drawn", F.when(n > shown, drawn_place(hash_, n - shown + 1)))
    space = F.locate(" ", F.substring(text, F.col("_drawn") + 1, F.lit(shown)))  # within the window, or 0
    begun = drawn.withColumn("_from", F.col("_drawn") + F.coalesce(space, F.lit(0)))
    window = begun.withColumn("_window", F.substring(text, F.col("_from") + 1, F.lit(shown)))
    back = F.length("_window") - F.locate(" ", F.reverse(F.col("_window")))  # characters ahead of the last space
    cut = F.when(F.contains("_window", F.lit(" ")) & (back > 0), F.substring(F.col("_window"), F.lit(1), back)).otherwise(F.col("_window"))
    ended = window.withColumn("_cut", cut)
    piece = F.concat(F.when(F.col("_from") > 0, "… ").otherwise(""), F.regexp_replace("_cut", _BLANK, ""), F.when(F.col("_from") + F.length("_cut") < n, " …").otherwise(""))
    return ended.withColumn("snippet", F.when(n <= shown, text).otherwise(piece)).drop("_drawn", "_from", "_window", "_cut")


def best_start(spans: list[tuple[int, int, int]], n_words: int, size: int) -> int:
    """The first word of the window of `size` words that holds the most different terms whole, the first of equals. spans: (first word, last word, term) of occurrences.

    Two pointers over the occurrences: windows only gain a term where an occurrence's end comes in, so only those starts are looked at.
    """
    last = max(0, n_words - size)
    spans = sorted(x for x in set(spans) if x[1] - x[0] < size)
    starts = sorted({0, *(min(last, max(0, end - size + 1)) for _, end, _ in spans)})
    ends = sorted(spans, key=lambda x: x[1])
    held: dict[int, int] = {}
    came = gone = best = most = 0
    for start in starts:
        while came < len(ends) and ends[came][1] < start + size:
            held[ends[came][2]] = held.get(ends[came][2], 0) + 1
            came += 1
        while gone < len(spans) and spans[gone][0] < start:
            held[spans[gone][2]] -= 1
            held = {k: v for k, v in held.items() if v}
            gone += 1
        if len(held) > most:
            best, most = start, len(held)
    return best


def occurrences(words: list[list[str]], terms: list[str]) -> list[tuple[int, int, int]]:
    """(first word, last word, term) wherever a term stands; words: the tokens of each word; a term of several tokens is a phrase and counts as one."""
    flat = [(token, at) for at, found in enumerate(words) for token in found]
    asked: dict[str, list[tuple[list[str], int]]] = {}
    for k, term in enumerate(terms):
        first, *_ = parts = term.split(" ")
        asked.setdefault(first, []).append((parts, k))
    out = []
    for i, (token, at) in enumerate(flat):
        for parts, k in asked.get(token, ()):
            if i + len(parts) <= len(flat) and all(flat[i + j][0] == x for j, x in enumerate(parts)):
                out.append((at, flat[i + len(parts) - 1][1], k))
    return out


def with_best_window(rows: DataFrame, terms: str = "terms", value: str = "value", size: int = BEST) -> DataFrame:
    """Adds snippet, the run of `size` words that holds the most different terms (the first of equals), for rows that survived a limit."""
    columns = [c for c in rows.columns]
    words = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), _BLANK, ""), r"\s+")
    given = rows.withColumn("_words", words).withColumn("_tokens", F.transform("_words", lambda w: tokens(w)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shown, each, asked in zip(*(batch.column(c).to_pylist() for c in ("_words", "_tokens", terms))):
                start = best_start(occurrences(each, asked or []), len(shown), size)
                out.append(("…" if start else "") + " ".join(shown[start : start + size]) + ("…" if start + size < len(shown) else ""))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], [*columns, "snippet"])

    kinds = dict(rows.dtypes)
    return given.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "snippet string"]))
