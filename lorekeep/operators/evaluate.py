"""Retrieval metrics, rank correlations and parameter sweeps."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import fusion


#: Passages that are sent to all tasks; more meet the texts by a shuffle of the texts' words.
BROADCAST_PASSAGES = 50_000


def holding(docs: DataFrame, passages: DataFrame, broadcast_passages: int = BROADCAST_PASSAGES) -> DataFrame:
    """(query_id, id) of texts in docs (id, text) that hold a whole passage of passages (query_id, passage), each once.

    Passages are found by a hash of their second to fifth word, which stand in the text as they are, and then compared. While passages are few,
    texts are read once and only what is found is shuffled. Those without inner words enough (fewer than six words) meet all texts.
    """
    key = lambda i: F.xxhash64(*(F.get("w", i + n) for n in range(1, 5)))
    passages = passages.filter("passage IS NOT NULL").withColumn("w", F.split("passage", " "))
    n_long, n_short = passages.agg(F.count_if(F.size("w") > 5), F.count_if(F.size("w") <= 5)).first()
    long, short = passages.filter(F.size("w") > 5).select("query_id", "passage", key(F.lit(0)).alias("key")), passages.filter(F.size("w") <= 5).select("query_id", "passage")
    # explode_outer: for explode Spark would derive a filter and split all texts once more for it
    last = F.size("w") - 6
    words = docs.withColumn("w", F.split("text", " ")).select("*", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("place")).withColumn("key", key(F.col("place")))
    if n_long <= broadcast_passages:
        found = words.join(F.broadcast(long), "key").filter(F.contains("text", "passage")).select("query_id", "id")
    else:
        met = words.select(F.col("id").alias("own"), "key").distinct().join(long, "key").select("query_id", "passage", "own").distinct()
        found = met.join(docs, F.col("own").eqNullSafe(F.col("id"))).filter(F.contains("text", "passage")).select("query_id", "id")
    if n_short:
        found = found.unionByName(docs.join(F.broadcast(short) if n_short <= broadcast_passages else short, F.contains("text", "passage")).select("query_id", "id"))
    return found.distinct()


def _judged(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    return hits.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def metrics(queries: DataFrame, hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """ndcg, reciprocal_rank and recall of each query; hits: (query_id, id, rank from 1), relevant: (query_id, id). Without relevant ids all are 0."""
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = _judged(hits, relevant).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias("n_found"),
    )
    ideal = F.element_at(F.array(*(F.lit(sum(1 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1))), F.least("n_relevant", F.lit(k)).cast("int"))
    return queries.select("query_id").join(wanted, "query_id", "left").join(got, "query_id", "left").select(
        "query_id", F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("n_found") / F.col("n_relevant"), F.lit(0.0)).alias("recall"),
    )


def macro_average(rows: DataFrame, *by: str) -> DataFrame:
    """Means of the metrics over all queries, in each group; a query counts once, whatever it has found."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_queries"), *(F.avg(c).alias(c) for c in ("ndcg", "reciprocal_rank", "recall")))


def kendall_tau(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Rank correlation of two lists (*by, id, rank) over their common ids, in each group; lists are the ends of a search, so pairs are few."""
    both = a.select(*by, "id", F.col("rank").alias("x")).join(b.select(*by, "id", F.col("rank").alias("y")), [*by, "id"])
    other = both.select(*by, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = both.join(other, list(by)).filter("id < id2")
    sign = F.signum((F.col("x") - F.col("x2")) * (F.col("y") - F.col("y2")))
    return pairs.groupBy(*by).agg((F.sum(sign) / F.count("*")).alias("tau"))


def average_ranks(rows: DataFrame, column: str, name: str, *by: str) -> DataFrame:
    """Ranks from 1 in ascending order; equal values share their mean rank."""
    group = Window.partitionBy(*by)
    return rows.withColumn(name, F.rank().over(group.orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0)


def spearman(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Correlation of average ranks in each group; NULL where one side has a single value."""
    ranks = average_ranks(average_ranks(rows, a, "rank_a", *by), b, "rank_b", *by)
    return ranks.groupBy(*by).agg(F.try_divide(F.covar_pop("rank_a", "rank_b"), F.stddev_pop("rank_a") * F.stddev_pop("rank_b")).alias("rho"), F.count("*").alias("n"))


def nearest_rank_percentile(rows: DataFrame, column: str, q: float, *by: str) -> DataFrame:
    """The value at place ceil(q * n) of each group."""
    order = Window.partitionBy(*by).orderBy(column)
    rows = rows.select(*by, column, F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    return rows.filter(F.col("place") == F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))).select(*by, F.col(column).alias("value"))


# The narrow sweep's points and the wide sweep's axes. Windows are the candidates of each list for a limit of 10.
SWEEP_K, SWEEP_WEIGHTS = (10, 30, 60), ((1.0, 1.0), (1.0, 2.0), (2.0, 1.0))
RRF_GRID = {"k": (10, 30, 60, 120), "weights": SWEEP_WEIGHTS, "min_score": (0.0, 0.3, 0.5, 0.7), "window": (100, 50)}


def rrf_points() -> list[dict]:
    """The 96 points of RRF_GRID."""
    return [{"point": n, "k": k, "w0": w[0], "w1": w[1], "min_score": m, "window": c} for n, (k, w, m, c) in enumerate(itertools.product(*RRF_GRID.values()))]


#: The grid of a sweep with affinity: constants of the fusion, weights of both lists, weights of affinity and candidates per list.
GRID = {"k": (10, 30, 60, 120), "weights": ((1.0, 1.0), (2.0, 1.0), (1.0, 2.0)), "affinity": (0.0, 0.05, 0.1, 0.2), "window": (50, 100)}


def grid() -> list[dict]:
    """The 96 points of GRID."""
    return [{"point": n, "k": k, "w0": w[0], "w1": w[1], "affinity": a, "window": c} for n, (k, w, a, c) in enumerate(itertools.product(*GRID.values()))]


def _points(points: list[dict]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in p.items())) for p in points))


def rrf_sweep(lists: DataFrame, points: list[tuple[int, float, float]], *by: str) -> DataFrame:
    """Fuse the same two ranked lists (list_no 0 and 1) at each point (k, weight 0, weight 1): ranks are found once, points are exploded beside them."""
    rows = lists.select(*by, "list_no", "rank", "id", "path", F.explode(_points([{"point": n, "k": k, "w0": a, "w1": b} for n, (k, a, b) in enumerate(points)])).alias("g"))
    return fusion.rrf(_weighed(rows, by), 0, *by, "point")


def rrf_grid(lists: DataFrame, points: list[dict], *by: str) -> DataFrame:
    """Fuse the same two ranked lists at each point of rrf_points(): (*by, point, id, path, score, rank) of what reaches the point's least score."""
    rows = lists.select(*by, "list_no", "rank", "id", "path", F.explode(_points(points)).alias("g")).filter(F.col("rank") <= F.col("g.window"))
    least = F.element_at(F.array(*(F.lit(p["min_score"]) for p in points)), F.col("point") + 1)
    return fusion.rrf(_weighed(rows, by), 0, *by, "point").filter(F.round("score", 9) >= least)


def _weighed(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    # a rank moved by the difference of the ks makes one k serve all points
    return rows.select(*by, "id", "path", "list_no", (F.col("rank") + F.col("g.k")).alias("rank"), F.col("g.point").alias("point"), F.when(F.col("list_no") == 0, F.col("g.w0")).otherwise(F.col("g.w1")).alias("weight"))


def affinity_sweep(lists: DataFrame, places: DataFrame, points: list[dict], threshold: float, *by: str) -> DataFrame:
    """Fuse, boost and consolidate the same two lists at each point of a grid: (*by, point, id, ranking, place). places: (id, source_file, chunk_index)."""
    rows = lists.select(*by, "list_no", "rank", "id", "path", F.explode(_points(points)).alias("g")).filter(F.col("rank") <= F.col("g.window"))
    weight = F.create_map(*(F.lit(x) for p in points for x in (p["point"], p["affinity"])))
    fused = fusion.rrf(_weighed(rows, by), 0, *by, "point").drop("rank").join(places, "id")
    return fusion.consolidate(fusion.affinity(fused, weight[F.col("point")], threshold, *by, "point"), threshold, *by, "point")
