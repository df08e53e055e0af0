"""Statistics of a document's text, computed in tasks from Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm._shared import lean, shingles, slices, span_hashes, word_spans

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_punct", "n_unique_words", "n_top_word", "sum_sq_word", "n_long_words", "n_short_words", "n_breaks")

_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCT = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words in 5-word windows found twice or more, the first included. hashes: of the windows, so that only those whose hash repeats are compared."""
    if len(words) < 6 or len(hashes) < 2:
        return 0
    ordered = np.sort(hashes)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(hashes, again)).tolist()
    found = Counter(tuple(words[i : i + 5]) for i in at)
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if found[tuple(words[i : i + 5])] > 1:
            covered[i] += 1
            covered[min(i + 5, len(words))] -= 1
    return int((np.cumsum(covered) > 0).sum())


def rows(column: pa.Array) -> Iterator[list[int]]:
    """The statistics of each text, as NAMES has them."""
    for lo, hi, data, offsets in slices(column):
        raw = data.tobytes()
        starts, ends, doc = word_spans(data, offsets)
        each = span_hashes(data, starts, ends)
        hashes, of = shingles(data, offsets)
        words_at = np.searchsorted(doc, np.arange(hi - lo + 1))
        shingles_at = np.searchsorted(of, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            text = raw[offsets[k] : offsets[k + 1]]
            a, b = words_at[k], words_at[k + 1]
            words = text.split()
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            codes = len(text) - int(((data[offsets[k] : offsets[k + 1]] & 0xC0) == 0x80).sum())
            sizes = ends[a:b] - starts[a:b]
            unique, counts = np.unique(each[a:b], return_counts=True)
            yield [
                b - a, codes - _count(text, _WHITE), _count(text, _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words, hashes[shingles_at[k] : shingles_at[k + 1]]),
                len(lines), codes, _count(text, _UPPER), _count(text, _DIGITS), _count(text, _PUNCT), len(unique), int(counts.max()) if len(counts) else 0,
                int((sizes.astype(np.int64) ** 2).sum()), int((sizes > 12).sum()), int((sizes < 4).sum()), text.count(b"\n"),
            ]


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs and the statistics of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.array(list(rows(batch.column("text"))), np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[:, k]) for k in range(len(NAMES)))], [*keep, *NAMES])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(lean(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{n} long" for n in NAMES)]))
