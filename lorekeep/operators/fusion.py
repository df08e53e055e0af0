"""Reciprocal rank fusion, source affinity and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: DataFrame, k: int, *by: str, min_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """Fuse ranked lists: from rows (*by, list_no, weight, rank, id, path) the rows (*by, id, path, score, rank).

    score is the sum of weight / (k + rank), divided by the group's largest; lists of weight 0 take no part.
    """
    summed = lists.filter("weight <> 0").groupBy(*by, "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min_by("path", "list_no").alias("path"))
    scored = summed.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(*by))).filter(F.col("score") >= min_score)
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "path", "id")))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def merge_contexts(per_context: DataFrame, k: int, *by: str) -> DataFrame:
    """Fuse the lists of several contexts by rank alone: (*by, context, rank, id, path)."""
    return rrf(per_context.select(*by, F.col("context").alias("list_no"), F.lit(1.0).alias("weight"), "rank", "id", "path"), k, *by)


def sibling_counts(candidates: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Candidates with the number of their file's neighbouring chunks that score within threshold of the best."""
    floor = F.max("score").over(Window.partitionBy(*by)) - threshold
    seen = candidates.withColumn("visible", F.when(F.col("score") >= floor, 1).otherwise(0))
    spots = seen.filter("source_file IS NOT NULL").groupBy(*by, "source_file", "chunk_index").agg(F.sum("visible").alias("n"))
    near = spots.select(*by, "source_file", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"), "n")
    near = near.groupBy(*by, "source_file", "chunk_index").agg(F.sum("n").alias("siblings"))
    return candidates.join(near, [*by, "source_file", "chunk_index"], "left").withColumn("siblings", F.coalesce("siblings", F.lit(0)))


def affinity(candidates: DataFrame, weight: float | Column, threshold: float, *by: str, total: bool = False) -> DataFrame:
    """Boost candidates (*by, id, path, source_file, chunk_index, score) by their visible siblings and put them in order.

    Adds boosted, doc_score (the file's largest boosted score, or with total their sum) and place. A weight of 0 or less changes nothing but the order's columns.
    """
    source = Window.partitionBy(*by, "source_file")
    rows = sibling_counts(candidates, threshold, *by).withColumn("boosted", F.col("score") + F.greatest(F.lit(0.0), weight if isinstance(weight, Column) else F.lit(float(weight))) * F.col("siblings"))
    doc = F.sum("boosted").over(source) if total else F.greatest(F.lit(0.0), F.max("boosted").over(source))
    rows = rows.withColumn("doc_score", F.when(F.col("source_file").isNull(), F.col("boosted")).otherwise(doc))
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("boosted", 9)), F.desc(F.round("doc_score", 9)), "path", "chunk_index", "id")
    return rows.withColumn("place", F.row_number().over(order))


def consolidate(boosted: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Drop a file's neighbours of its best chunk that score at least threshold less, then divide by the largest score left."""
    source = Window.partitionBy(*by, "source_file").orderBy("place")
    rows = boosted.withColumn("best_index", F.first("chunk_index").over(source)).withColumn("best_score", F.first("boosted").over(source)).withColumn("is_best", F.row_number().over(source) == 1)
    merged = F.col("source_file").isNotNull() & ~F.col("is_best") & (F.abs(F.col("best_index") - F.col("chunk_index")) == 1) & (F.round(F.col("best_score") - F.col("boosted"), 9) >= threshold)
    rows = rows.filter(~merged).drop("best_index", "best_score", "is_best")
    return rows.withColumn("ranking", F.col("boosted") / F.max("boosted").over(Window.partitionBy(*by)))
