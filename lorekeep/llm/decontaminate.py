"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Fixed masks select some of a few consecutive tokens and ignore the others. The selected tokens of every place of every
benchmark item and of every document are hashed, the hashes are joined, and each hit names a diagonal: an item laid over a
document at an offset. On it tokens are compared one by one; the item is in the document if some window of WINDOW item
tokens (all of them in a shorter item) agrees in at least AGREE of its places. The masks hit each such window whatever
places differ, as a test shows by trying all. Items of fewer than LEAST tokens have masks of their own length, which are used
only where the benchmark has such items.

The documents are read once and nothing of them is shuffled but the verified pairs: seeds are broadcast while there are
at most BROADCAST_SEEDS of them; with more, narrow rows of hashes are joined by a shuffle and the hits meet the texts by
doc_id, those of rows without one by a digest of the text. Both ways give the same rows. Texts are looked up in pieces, and a hit takes along
only the tokens on which its item lies: generated code holds all hits of a row at once, and with a long text in each of them that filled executors.

Defined results: null and empty texts match nothing; items of fewer than WEIGHTY tokens are found by leaks(), but
clean() removes no document for their sake unless weighty says so, as any text may hold so few words; for an item that
fits a document in several places the best figures are returned; repeated rows of a doc_id or item_id are one; rows
without doc_id are found as a null doc_id, and clean() judges each of them by its own text; an empty
table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import documents, stash

#: 1: the token counts, 0: it is ignored.
MASKS = ("11011", "1101001")
WINDOW, AGREE, LEAST, WEIGHTY = 13, 0.8, 7, 4
BROADCAST_SEEDS = 1_000_000
#: Places of a text that are looked up at a time, unless items are longer than half of that.
PLACES = 4096
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_TOKEN), "")


def short_masks(n: int) -> list[str]:
    """Masks for an item of n tokens: all of them, or all but one where one may differ."""
    return ["1" * n] if n < 5 else ["1" * k + "0" + "1" * (n - 1 - k) for k in range(n)]


def all_masks(sizes: list[int], masks: tuple[str, ...] = MASKS) -> list[tuple[int, str, int]]:
    """(number, mask, size) for benchmarks with items of these sizes below LEAST: size is that of the items that have it, or LEAST for all others."""
    return [*((k, mask, LEAST) for k, mask in enumerate(masks)), *((100 * n + k, mask, n) for n in sorted(sizes) for k, mask in enumerate(short_masks(n)))]


def alone(mask: str, window: int, agree: float) -> bool:
    """Whether a mask hits each window that agrees well enough by itself: a place that differs spoils at most as many of its positions as it selects tokens."""
    return mask.count("1") * (window - math.ceil(agree * window - 1e-9)) < window - len(mask) + 1


def needed(sizes: list[int], masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE) -> list[tuple[int, str, int, int | None]]:
    """(number, mask, least, most) for benchmarks with items of these sizes below window: items of least to most tokens have the mask. Items of a window or more need only one that suffices."""
    one = next((k for k, mask in enumerate(masks) if window >= LEAST and alone(mask, window, agree)), None)
    out = []
    for k, mask, size in all_masks([n for n in sizes if n < LEAST], masks):
        if size < LEAST:
            out.append((k, mask, size, size))
        elif one is None or k == one:
            out.append((k, mask, LEAST, None))
        elif any(n >= LEAST for n in sizes):
            out.append((k, mask, LEAST, window - 1))
    return out


def _seeded(rows: DataFrame, masks: list[tuple[int, str, int, int | None]], items: bool = False) -> DataFrame:
    """A row (place, seed and other columns) for each place from `first` to `last` of an array of tokens and each mask; an item has only the masks of its size.

    Places are exploded before tokens are picked, so that a row has its tokens by reference and no array of seeds is made. A mask that goes beyond the tokens' end
    makes a seed of those up to there, which at most finds a diagonal too many. It is explode_outer since for explode Spark would derive a filter on the
    array's size and push it below, where all is made over again.
    """
    size, place = F.size("hashes"), F.col("place")
    last = F.least(F.col("last"), size - min(len(mask) for _, mask, _, _ in masks))
    rows = rows.withColumn("hashes", F.transform("tokens", lambda x: F.xxhash64(x)))
    rows = rows.select("*", F.explode_outer(F.when(last >= F.col("first"), F.sequence(F.col("first"), last))).alias("place"))

    def seed(number: int, mask: str, least: int, most: int | None) -> Column:
        hashed = F.xxhash64(F.lit(number), *(F.get("hashes", place + k) for k, bit in enumerate(mask) if bit == "1"))
        return F.when((size >= least) & (size <= most if most else F.lit(True)) & (place + len(mask) <= size), hashed) if items else hashed

    found = [seed(*mask) for mask in masks]
    return rows.select("*", (found[0] if len(found) == 1 else F.explode(F.array(*found))).alias("seed"))


def _pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, text_key, tokens, begin, first, last) for each PLACES places of a text: the tokens there and as many around them as an item may need. begin is the number of the
    first token, first and last tell the places among them. What is found in a piece waits in memory until the piece is done."""
    places, start, size = max(PLACES, 2 * longest), F.col("start"), F.size("words")
    rows = docs.select("doc_id", text_key(), tokens("text").alias("words"))
    rows = rows.select("*", F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(places)))).alias("start"))
    begin = F.greatest(start - longest, F.lit(0))
    return rows.select("doc_id", "text_key", F.slice("words", begin + 1, start - begin + places + longest).alias("tokens"), begin.alias("begin"), (start - begin).alias("first"), (start - begin + places - 1).alias("last"))


def _laid(hits: DataFrame, *kept: str) -> DataFrame:
    """hits (tokens, offset, n) with only those tokens on which an item of n tokens lies, and its offset among them: 0, or below if it begins before them."""
    before = F.least("offset", F.lit(0))
    return hits.select(*kept, F.slice("tokens", F.greatest("offset", F.lit(0)) + 1, F.greatest(F.col("n") + before, F.lit(0))).alias("tokens"), before.alias("offset"))


def _verified(hits: DataFrame, window: int, agree: float) -> DataFrame:
    """From (doc_id, text_key, item_id, tokens, item, offset): the pairs that agree well enough, with their best figures."""
    same = F.transform("item", lambda x, i: F.when(F.get("tokens", F.col("offset") + i) == x, 1).otherwise(0))
    hits = hits.filter(F.aggregate(same, F.lit(0), lambda a, x: a + x) >= agree * F.least(F.size("item"), F.lit(window)))
    hits = hits.select("doc_id", "text_key", "item_id", same.alias("same")).withColumn("n_agree", F.aggregate("same", F.lit(0), lambda a, x: a + x)).withColumn("span", F.least(F.size("same"), F.lit(window)))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("span") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("span")), F.lit(0), lambda a, x: a + x))
    hits = hits.withColumn("best_window", F.array_max(sums)).filter(F.col("best_window") >= agree * F.col("span"))
    return hits.select("doc_id", "text_key", "item_id", "best_window", "n_agree", F.size("same").alias("n_tokens"))


def text_key() -> Column:
    """A digest that tells rows without doc_id apart; null for the others."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary"))).alias("text_key")


def _found(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Rows (doc_id, text_key, item_id, best_window, n_agree, n_tokens) for each place of a document that an item fits."""
    items = benchmark.select("item_id", tokens("text").alias("item")).filter(F.size("item") > 0).distinct()
    items = stash(items.withColumn("item_key", F.monotonically_increasing_id()))
    size = F.size("item")
    sizes = items.agg(F.max(size).alias("longest"), F.collect_set(F.when(size < max(LEAST, window), size)).alias("short")).first()
    longest, used = sizes["longest"] or 0, needed(sizes["short"], masks, window, agree)
    each = _seeded(items.select("item_key", F.col("item").alias("tokens"), F.lit(0).alias("first"), (size - 1).alias("last"), size.alias("n")), used, items=True)
    each = each.select("item_key", "seed", F.col("place").alias("item_place"), "n").filter("seed IS NOT NULL")
    rows = _seeded(_pieces(docs, longest), used)
    offset = F.col("place") - F.col("item_place")
    if each.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        hits = _laid(rows.join(F.broadcast(each), "seed").withColumn("offset", offset), "doc_id", "text_key", "item_key")
        hits = hits.join(F.broadcast(items), "item_key")
    else:
        hits = rows.select("doc_id", "text_key", "begin", "place", "seed").join(each, "seed").select("doc_id", "text_key", "item_key", (F.col("begin") + offset).alias("offset")).distinct()
        texts = docs.select(F.col("doc_id").alias("own_id"), text_key().alias("own_key"), tokens("text").alias("tokens"))
        hits = hits.join(items, "item_key").join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("text_key").eqNullSafe(F.col("own_key")))
        hits = _laid(hits.withColumn("n", size), "doc_id", "text_key", "item_id", "item")
    return _verified(hits, window, agree)


def leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage: doc_id, item_id, best_window, n_agree, n_tokens."""
    return _found(docs, benchmark, **parameters).groupBy("doc_id", "item_id").agg(*(F.max(x).alias(x) for x in ("best_window", "n_agree", "n_tokens")))


def clean(docs: DataFrame, benchmark: DataFrame, weighty: int = WEIGHTY, **parameters) -> DataFrame:
    """The documents that hold no passage of a benchmark item of `weighty` tokens or more; with 1 items of any length count."""
    found = _found(docs, benchmark, **parameters).filter(F.col("n_tokens") >= weighty).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct()
    rows = docs.select(F.struct("*").alias("document"), "doc_id", text_key())
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("leak_id")) & F.col("text_key").eqNullSafe(F.col("leak_key")), "left_anti").select("document.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sql() -> str:
    def seeded(table: str, key: str, size: str = "true") -> str:
        each = [(number, mask, f"{size} AND EXISTS (SELECT 1 FROM kept WHERE len(tokens) {'>=' if n == LEAST else '='} {n})".replace("SIZE", f"len(tokens) {'>=' if n == LEAST else '='} {n}")) for number, mask, n in all_masks(list(range(1, LEAST)))]
        return " UNION ALL ".join(rf"SELECT {key}, {n} AS mask, i - 1 AS place, [{', '.join(f'tokens[i + {k}]' for k, bit in enumerate(mask) if bit == '1')}] AS seed FROM (SELECT {key}, tokens, unnest(range(1, len(tokens) - {len(mask) - 2})) AS i FROM {table} WHERE {only})" for n, mask, only in each)

    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tokens"
    return f"""
WITH items AS (SELECT DISTINCT item_id, {split} FROM benchmark), kept AS (SELECT * FROM items WHERE len(tokens) > 0),
docs AS (SELECT doc_id, {split} FROM documents),
a AS ({seeded("docs", "doc_id")}), b AS ({seeded("kept", "item_id", "SIZE")}),
hits AS (SELECT DISTINCT a.doc_id, b.item_id, a.place - b.place AS shift FROM a JOIN b USING (mask, seed)),
same AS (SELECT doc_id, item_id, list_transform(range(1, len(k.tokens) + 1), lambda j: CASE WHEN shift + j >= 1 AND coalesce(d.tokens[CASE WHEN shift + j >= 1 THEN shift + j ELSE NULL END] = k.tokens[j], false) THEN 1 ELSE 0 END) AS same
  FROM hits JOIN docs d USING (doc_id) JOIN kept k USING (item_id)),
spans AS (SELECT *, least(len(same), {WINDOW}) AS span, list_sum(same) AS n_agree FROM same),
best AS (SELECT *, list_max(list_transform(range(1, len(same) - span + 2), lambda s: list_sum(same[s:s + span - 1]))) AS best_window FROM spans)
SELECT doc_id, item_id, max(best_window)::INT AS best_window, max(n_agree)::INT AS n_agree, max(len(same))::INT AS n_tokens
FROM best WHERE best_window >= {AGREE} * span GROUP BY ALL
"""
