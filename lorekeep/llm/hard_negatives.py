"""Hard-negative mining by a norm-bucketed search.

Vectors are whole numbers (floor of SCALE times each component), scores their inner products, so all comparisons are exact. An anchor's positives are its
best rows of the same label, and its hard negatives rows of other labels whose score lies in a window below a positive's.

1. Candidates are dealt into stripes by a hash of their number, so that each stripe has its share of every norm. A task sorts its stripe by norm, the largest
   first, and cuts it into buckets of BUCKET rows. All anchors visit each stripe, in blocks of BLOCK.
2. A score is at most the product of the norms (Cauchy-Schwarz). A block's anchors are multiplied with one bucket after the other; an anchor leaves when its norm times
   the bucket's largest is below what still counts for it: the lower limit of each of its windows, or the k-th score that the
   window has so far. Norms only fall from there, so nothing behind that bucket can count for it.
3. A stripe returns at most k rows per anchor and window; their union is ranked.

Positives are searched first in this way (one window without limits), negatives in a second pass with the windows that follow from them. A product of norms below
2**24 (2**53) is multiplied in single (double) precision, in which all sums of whole numbers up to there are exact; larger ones in 64-bit integers.

Anchors are a fixed share of all rows and are sent to every stripe; stripes have about STRIPE rows, so that rows x anchors / STRIPE rows of anchors are
shuffled, and every anchor meets every bucket that the bound doesn't rule out. A task holds one stripe and one block.

Defined results: rows without number, label or vector, or with a component that is null or not finite, take no part, nor do those whose squared norm
reaches 2**62, as scores would not fit a long; a repeated row counts once; rows with equal numbers and other content are rows of their own, but never each
other's positive or negative; a shorter vector counts as filled with zeros; a positive of negative score has an empty window; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm._shared import lean, stash

SCALE, EVERY, POSITIVES, NEGATIVES, LEAST, MOST = 256, 100, 5, 10, 30, 90
BUCKET, BLOCK, STRIPE = 1024, 512, 1 << 17
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_TOO_LARGE = float(1 << 62)


def whole(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector, norm) of the rows that take part, each once: components as longs, and their norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes nan
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                squares = np.append(flat * flat, 0.0)
                norm = np.where(sizes > 0, np.add.reduceat(squares, np.minimum(edges[:-1], len(flat))), 0.0) if len(sizes) else np.zeros(0)
            fits = norm < _TOO_LARGE  # false for nan
            of = np.repeat(fits, sizes)
            values = np.where(of, flat, 0.0).astype(np.int64)
            vector = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vector, pa.array(np.sqrt(norm))], ["vec_id", "label", "vector", "norm"]).filter(pa.array(fits))

    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.mapInArrow(lean(run), "vec_id long, label long, vector array<long>, norm double").dropDuplicates(["vec_id", "label", "vector"])


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of a list column, filled with zeros to the longest or to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; largest: of the products of their norms."""
    width = min(a.shape[1], b.shape[1])  # what one of them lacks is zero
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    return (a[:, :width].astype(kind) @ b[:, :width].astype(kind).T).astype(np.int64)


class Buckets:
    """A stripe's candidates by falling norm, cut into buckets."""

    def __init__(self, table: pa.Table, size: int):
        ids, labels, norms = (table.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
        vectors = matrix(table.column("vector"))
        order = np.lexsort((ids, -norms))
        self.cut = [(ids[x], labels[x], vectors[x], norms[x[0]]) for x in (order[k : k + size] for k in range(0, len(order), size))]


def search(anchors: dict[str, np.ndarray], buckets: Buckets, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each anchor and window: (anchor's place, window's place, score, vec_id). low and high: the limits, a row per anchor and a column per window; same: of the anchor's label, else of others."""
    n, windows = low.shape
    top = np.full((n, windows, k), _LOW, np.int64)
    top_id = np.full((n, windows, k), _HIGH, np.int64)
    active = np.flatnonzero((low <= high).any(1))
    for ids, labels, vectors, norm in buckets.cut:
        bound = anchors["norm"][active] * norm * (1 + 1e-9) + 1  # surely no less than any score
        wanted = np.where(low <= high, np.maximum(low, top[:, :, -1]), _HIGH)[active].min(1)
        active = active[bound >= wanted]
        if not len(active):
            break
        scores = products(anchors["vector"][active], vectors, float(anchors["norm"][active].max() * norm) * (1 + 1e-9) + 1)
        fits = (anchors["label"][active][:, None] == labels) == same
        fits &= anchors["vec_id"][active][:, None] != ids
        for j in range(windows):
            least, last = top[active, j, -1][:, None], top_id[active, j, -1][:, None]
            use = fits & (scores >= low[active, j][:, None]) & (scores <= high[active, j][:, None]) & ((scores > least) | (scores == least) & (ids < last))
            row, col = np.nonzero(use)
            if not len(row):
                continue
            touched, row = np.unique(row, return_inverse=True)
            own = active[touched]
            who = np.concatenate([np.repeat(np.arange(len(own)), k), row])
            score = np.concatenate([top[own, j].ravel(), scores[touched[row], col]])
            named = np.concatenate([top_id[own, j].ravel(), ids[col]])
            order = np.lexsort((named, ~score, who))
            place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
            order, place = order[place < k], place[place < k]
            top[own[who[order]], j, place] = score[order]
            top_id[own[who[order]], j, place] = named[order]
    at, j, place = np.nonzero(top_id < _HIGH)
    return at, j, top[at, j, place], top_id[at, j, place]


def _met(candidates: DataFrame, anchors: DataFrame, stripes: int) -> DataFrame:
    """Candidates (kind 0) and anchors (kind 1) of each stripe, the candidates first."""
    columns = ["vec_id", "label", "vector", "norm"]
    rows = candidates.select(F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor"), *columns, F.lit(None).cast("array<long>").alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(1).alias("kind"), "anchor", *columns, "scores")
    return rows.unionByName(asked).repartition("stripe").sortWithinPartitions("stripe", "kind")


def windows(scores: pa.Array, percent: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Limits of each anchor's windows: from the one to the other share of each of its scores, or one window without limits where it has none."""
    sizes = pc.fill_null(pc.list_value_length(scores), -1).to_numpy(zero_copy_only=False)
    given = matrix(pc.if_else(pc.is_valid(scores), scores, pa.scalar([], scores.type)), 1)
    whole_part, rest = given // 100, given % 100
    low, high = whole_part * percent[0] - (-rest * percent[0]) // 100, whole_part * percent[1] + rest * percent[1] // 100
    none = (np.arange(given.shape[1]) >= sizes[:, None]) | (given < 0)
    low, high = np.where(none, 1, low), np.where(none, 0, high)
    low[sizes < 0, 0], high[sizes < 0, 0] = _LOW, _HIGH
    return low, high


def best(candidates: DataFrame, anchors: DataFrame, stripes: int, k: int, percent: tuple[int, int], same: bool) -> DataFrame:
    """(anchor, place, score, vec_id, rank): the k best candidates of each anchor and window. anchors: with anchor (a number) and scores (what windows follow from; null: one without limits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe, held, buckets = None, [], None
        for batch in batches:
            at = batch.column("stripe").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if at[lo] != stripe:
                    stripe, held, buckets = at[lo], [], None
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if not held and buckets is None:  # a stripe without candidates
                    continue
                if buckets is None:
                    buckets, held = Buckets(pa.Table.from_batches(held), BUCKET), []
                for a in range(lo, hi, BLOCK):
                    block = batch.slice(a, min(BLOCK, hi - a))
                    asked = {c: block.column(c).to_numpy() for c in ("anchor", "vec_id", "label", "norm")} | {"vector": matrix(block.column("vector"))}
                    where, j, score, vec_id = search(asked, buckets, *windows(block.column("scores"), percent), k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(asked["anchor"][where]), pa.array(j), pa.array(score), pa.array(vec_id)], ["anchor", "place", "score", "vec_id"])

    found = _met(candidates, anchors, stripes).mapInArrow(lean(run), "anchor long, place long, score long, vec_id long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, stripe: int = STRIPE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for embeddings (vec_id, label, embedding).

    Negatives' scores are from least to most hundredths of their positive's. is_anchor: which rows are anchors; unless given, those with vec_id divisible by EVERY.
    """
    rows = stash(whole(embeddings))
    anchors = stash(rows.filter(F.col("vec_id") % EVERY == 0 if is_anchor is None else is_anchor).withColumn("anchor", F.monotonically_increasing_id()))
    stripes = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // stripe))
    near = stash(best(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), stripes, positives, (0, 0), True))
    scores = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))  # at most `positives` of an anchor
    hard = best(rows, anchors.join(scores, "anchor"), stripes, negatives, (least, most), False)
    names = near.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = hard.join(names, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", moved.alias("label"), "embedding"))


SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
