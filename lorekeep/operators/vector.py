"""Exact cosine search over embedding columns, and the fusion of two vector lists.

Candidates are dealt into stripes, and all queries meet each stripe in a task, in blocks; neither passes through the driver. A clustered table gives each candidate the
cell of its nearest pivot and the angle between them. By the triangle inequality on the sphere a candidate is at least as far from a query as the query from the pivot, less
the largest angle of the cell: cells that are farther than the k-th candidate so far are not multiplied, which leaves nothing out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.sources.tables import exists

#: Query vectors that a task multiplies with at once, candidates of a stripe, and most pivots of a clustered table.
BLOCK, STRIPE, PIVOTS = 512, 1 << 17, 1024
#: By how much, as an angle, a cell must be too far; above the rounding of arcus cosine.
_SURE = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double; NULL for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def mean_pooled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of a group's vectors, in unit length."""
    flat = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    flat = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return flat.select(key, normalized(F.transform("v", lambda p: p.x)).alias(vector))


def _best(rows: pd.DataFrame, k: int, groups: list[str], tie: tuple[str, ...]) -> pd.DataFrame:
    """The k best rows of each group; similarities count as rounded, and ties are settled by the columns tie."""
    return rows.assign(_near=-rows["similarity"].round(9)).sort_values([*groups, "_near", *tie], kind="stable").groupby(groups, sort=False, dropna=False).head(k).drop(columns="_near")


def _unit(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def clustered(entries: DataFrame, path: str) -> DataFrame:
    """entries with an embedding, kept in a folder with the columns cell, pivot (its vector) and angle (to it), in the order of cells. Made once; a pivot stands for about as many entries as there are pivots."""
    spark = entries.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        held = entries.filter("embedding IS NOT NULL")
        many = int(min(PIVOTS, max(1, np.ceil(held.count() ** 0.5))))
        chosen = [r["embedding"] for r in held.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(many).collect()]  # at most PIVOTS
        pivots = np.array(chosen, np.float64) if chosen else np.zeros((0, 1))
        units = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((pivots, units))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, units = sent.value
            for batch in batches:
                if batch.num_rows:
                    near = _unit(batch.column("embedding")) @ units.T
                    cell = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(list(pivots[cell]), pa.list_(pa.float64())), pa.array(angle)], [*batch.schema.names, "cell", "pivot", "angle"])

        kinds = ", ".join([*(f"`{c}` {t}" for c, t in held.dtypes), "cell long", "pivot array<double>", "angle double"])
        held.mapInArrow(run, kinds).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Candidates:
    """A stripe's candidates, by group and cell."""

    def __init__(self, table: pa.Table, by: tuple[str, ...], kept: list[str]):
        self.frame = table.select(kept).to_pandas()
        self.vectors = _unit(table.column("embedding").combine_chunks())
        cells, angle, pivot = table.column("cell").to_numpy(zero_copy_only=False), table.column("angle").to_numpy(zero_copy_only=False), table.column("pivot")
        own = self.frame.assign(_cell=cells)
        self.groups: list[list[tuple[np.ndarray, np.ndarray | None, float]]] = []
        for rows in own.groupby(list(by), sort=False, dropna=False).indices.values() if by else [np.arange(len(own))]:
            found = []
            for part in pd.Series(rows).groupby(cells[rows], sort=False).indices.values() if not np.isnan(cells.astype(np.float64)).any() else [np.arange(len(rows))]:
                at = rows[part]
                known = pivot[int(at[0])].as_py() is not None
                found.append((at, _unit(pa.array([pivot[int(at[0])].as_py()]))[0] if known else None, float(angle[at].max()) if known else 0.0))
            self.groups.append(found)


def _nearest(candidates: _Candidates, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Rows, queries and similarities among which are the k best of each query and group, ties included; and how many (query, cell) there were and were multiplied."""
    out, met, read = [], 0, 0
    for cells in candidates.groups:
        best = np.full((len(queries), k), -np.inf)  # of each query, the k-th first
        bounds = np.column_stack([np.ones(len(queries)) if pivot is None else np.cos(np.maximum(0, np.arccos(np.clip(queries @ pivot, -1, 1)) - radius - _SURE)) for _, pivot, radius in cells])
        for c in np.argsort(-bounds.max(0), kind="stable").tolist():
            active = np.flatnonzero(bounds[:, c] >= best[:, 0] - 1e-8)
            met, read = met + len(queries), read + len(active)
            if not len(active):
                continue
            rows = cells[c][0]
            found = np.round(candidates.vectors[rows] @ queries[active].T, 9)
            top = found if len(rows) <= k else -np.partition(-found, k - 1, axis=0)[:k]
            merged = np.sort(np.concatenate([best[active].T, top]), axis=0)[-k:]
            best[active] = merged.T
            at, q = np.nonzero(found >= best[active, 0])
            out.append((rows[at], active[q], found[at, q]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), met, read
    rows, q, similarity = (np.concatenate(x) for x in zip(*out))
    return rows, q, similarity, met, read


def knn(entries: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = (), tie: tuple[str, ...] = ("id",), counted: bool = False, at_most: int | None = None) -> DataFrame:
    """The k nearest entries of each query, in each group of `by`: (query_id, *by, id, *tie, similarity, rank). Of equally near entries the first by the columns tie are taken.

    queries: (query_id, vector). entries may come from clustered(). At most k rows per stripe, query and group are shuffled for the final ranking. counted: instead, one row
    with cells_met and cells_read, over all queries. at_most: how many entries there are at most, where that is known; else they are counted.
    """
    kept, kinds, kind = list(dict.fromkeys(["id", *by, *tie])), dict(entries.dtypes), dict(queries.dtypes)["query_id"]
    held = entries.filter("embedding IS NOT NULL")
    spark = entries.sparkSession
    stripes = max(spark.sparkContext.defaultParallelism, -(-(held.select("id").count() if at_most is None else at_most) // STRIPE))
    cells = {"cell": "long", "pivot": "array<double>", "angle": "double"}
    full = held.select(*kept, "embedding", *(F.col(c) if c in held.columns else F.lit(None).cast(t).alias(c) for c, t in cells.items()))
    dealt = ["cell", F.pmod(F.xxhash64("id"), F.lit(max(1, stripes // 8)))] if "cell" in held.columns else ["id"]  # cells are split where there are many stripes, so that none is hot
    stripe = F.pmod(F.xxhash64(*dealt), F.lit(stripes)).cast("int")
    left = full.select(stripe.alias("stripe"), F.lit(0).alias("kind"), *full.columns, F.lit(None).cast(kind).alias("query_id"), F.lit(None).cast("array<double>").alias("vector"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in full.dtypes), "query_id", F.col("vector").cast("array<double>").alias("vector"))
    met = left.unionByName(asked).repartitionById(stripes, "stripe").sortWithinPartitions("stripe", "kind")  # a task for each, however few bytes it has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, data = None, [], None
        for batch in batches:
            at, kind_of = batch.column("stripe").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind_of[1:] != kind_of[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if at[lo] != now:
                    now, parts, data = at[lo], [], None
                if kind_of[lo] == 0:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if data is None and not parts:
                    continue
                data, parts = data or _Candidates(pa.Table.from_batches(parts), by, kept), []
                for a in range(lo, hi, BLOCK):
                    block = batch.slice(a, min(BLOCK, hi - a))
                    rows, q, similarity, n_met, n_read = _nearest(data, _unit(block.column("vector")), k)
                    if counted:
                        yield pa.RecordBatch.from_arrays([pa.array([n_met]), pa.array([n_read])], ["cells_met", "cells_read"])
                        continue
                    best = _best(data.frame.iloc[rows].assign(query_no=q, similarity=similarity), k, ["query_no", *by], tie)
                    query = block.column("query_id").take(pa.array(best.pop("query_no").to_numpy()))
                    found = pa.RecordBatch.from_pandas(best[[*kept, "similarity"]], preserve_index=False)
                    yield pa.RecordBatch.from_arrays([query, *found.columns], ["query_id", *kept, "similarity"])

    if counted:
        return met.mapInArrow(run, "cells_met long, cells_read long").agg(F.sum("cells_met").alias("cells_met"), F.sum("cells_read").alias("cells_read"))
    near = met.mapInArrow(run, ", ".join([f"query_id {kind}", *(f"`{c}` {kinds[c]}" for c in kept), "similarity double"]))
    order = Window.partitionBy("query_id", *by).orderBy(F.desc(F.round("similarity", 9)), *tie)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dual_fusion(content: DataFrame, structure: DataFrame, alpha: float = 0.5, *by: str) -> DataFrame:
    """alpha * content + (1 - alpha) * structure similarity over the union of both lists; a missing one counts 0."""
    keys = [*by, "id"]
    both = content.select(*keys, F.col("similarity").alias("c")).join(structure.select(*keys, F.col("similarity").alias("s")), keys, "full_outer")
    return both.select(*keys, (F.lit(alpha) * F.coalesce("c", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))
