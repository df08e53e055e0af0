"""Hybrid search of a batch of queries as one plan."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkAttributeError, PySparkException, PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import fusion, keyword, lifecycle, snippets, vector
from lorekeep.operators.index import Index, built
from lorekeep.plans import planner
from lorekeep.sources.tables import stash


@dataclass(frozen=True)
class Parameters:
    limit: int = 20
    min_score: float = 0.7
    k: int = 60
    keyword_weight: float = 1.0
    vector_weight: float = 1.0
    alpha: float = 0.5
    affinity_weight: float = 0.1
    consolidation_threshold: float = 0.1
    narrow_window: bool = False
    sum_of_scores: bool = False


def near_entries(inside: DataFrame, vectors: DataFrame, size: int, alpha: float, at_most: int | None = None) -> DataFrame:
    """The nearest entries (query_id, ctx, path, id, score) of each context: by content, or where entries have structure vectors by both, alpha of content."""
    by, tie = ("ctx",), ("path", "id")
    near = vector.knn(inside, vectors, size, by, tie, at_most=at_most)
    if "structure_embedding" not in inside.columns:
        return near.select("query_id", "ctx", "path", "id", F.col("similarity").alias("score"))
    shape = vector.knn(inside.withColumn("embedding", F.col("structure_embedding")), vectors, size, by, tie, at_most=at_most)
    return vector.dual_fusion(near, shape, alpha, "query_id", "ctx", "path")


def _attempt(name: str, make: Callable[[], DataFrame], warned: list[dict] | None) -> DataFrame | None:
    """A list as a table, or None and a warning where it cannot be had: a file is gone or a job has failed. An error in what is asked is raised."""
    try:
        return stash(make())
    except (PySparkException, Py4JJavaError) as e:
        asked_wrongly = isinstance(e, (AnalysisException, ParseException)) and e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
        if asked_wrongly or isinstance(e, (PySparkTypeError, PySparkValueError, PySparkAttributeError)):
            raise
        logging.getLogger(__name__).warning("%s search failed; the other list goes on alone", name)
        if warned is not None:
            warned.append({"modality": name, "error": str(e).splitlines()[0][:300]})
        return None


def warnings(spark: SparkSession, warned: list[dict]) -> DataFrame:
    """(modality, error) of the lists that hybrid() went on without."""
    return spark.createDataFrame([(x["modality"], x["error"]) for x in warned], "modality string, error string")


def hybrid(entries: DataFrame, queries: DataFrame, vectors: DataFrame, asked: list[str], p: Parameters = Parameters(), index: Index | None = None, warned: list[dict] | None = None) -> DataFrame:
    """Search the contexts `asked` (keys of the column ctx) for all queries at once.

    entries: with id, hash, ctx, path, source_file, section, value, embedding, chunk_index, and structure_embedding if there are any; queries: (query_id, text); vectors: (query_id, vector).
    index: the keyword index of the entries, where it is kept. In each context the keyword and the vector list are fused by
    rank, the contexts' lists by rank again, then files' neighbours support each other (not for paths, where the chunk that is named is the answer), weak
    neighbours of a file's best chunk are merged away, and min_score and limit apply. A weight of 0 leaves a list out. The lists are made apart: where one fails while it
    runs, the other answers alone and warned gets a row; where none is left, that is an error.
    Returns (query_id, id, ranking, rank).
    """
    size = planner.window(p.limit, p.narrow_window)
    inside, lists, failed = entries.filter(F.col("ctx").isin(*asked)), [], [] if warned is None else warned
    plans = stash(planner.planned(queries))  # small, and read by several joins

    def by_words() -> DataFrame:
        hits = keyword.planned(plans, built(entries) if index is None else index, p.limit, asked, size)
        best = keyword.ranked(hits, size, "query_id", "ctx").join(inside.select("id", "path"), "id")
        return best.withColumns({"list_no": F.lit(0), "weight": F.lit(p.keyword_weight)}).select(*columns)

    def by_vectors() -> DataFrame:
        near = keyword.ranked(near_entries(inside, vectors, size, p.alpha, None if index is None else index.entries), size, "query_id", "ctx", tie=("path", "id"))
        return near.withColumns({"list_no": F.lit(1), "weight": F.lit(p.vector_weight)}).select(*columns)

    columns = ("query_id", "ctx", "list_no", "weight", "rank", "id", "path")
    wanted = [("keyword", by_words)] * bool(p.keyword_weight) + [("vector", by_vectors)] * bool(p.vector_weight)
    lists = [x for x in (_attempt(*w, failed) for w in wanted) if x is not None]
    if wanted and not lists:
        raise RuntimeError("no list could be searched: " + "; ".join(x["error"] for x in failed))
    if not lists:
        return queries.select("query_id", F.lit(None).cast(dict(entries.dtypes)["id"]).alias("id"), F.lit(0.0).alias("ranking"), F.lit(0).alias("rank")).limit(0)
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    per_context = fusion.rrf(both, p.k, "query_id", "ctx").withColumnRenamed("ctx", "context")
    merged = fusion.merge_contexts(per_context, p.k, "query_id")
    found = merged.drop("rank").join(inside.select("id", "source_file", "chunk_index"), "id").join(plans.select("query_id", "is_path"), "query_id")
    weight = F.when(F.col("is_path"), 0.0).otherwise(p.affinity_weight)
    kept = fusion.consolidate(fusion.affinity(found, weight, p.consolidation_threshold, "query_id", total=p.sum_of_scores), p.consolidation_threshold, "query_id")
    kept = kept.filter(F.round("ranking", 9) >= p.min_score).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return kept.filter(F.col("rank") <= p.limit).select("query_id", "id", "ranking", "rank")


def fed_back(entries: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """entries after a search: what it has found is accessed once more and rated anew."""
    return lifecycle.bump_access(entries, results.select("id").distinct().join(entries.select("id", "hash"), "id"), now)


def shown(results: DataFrame, entries: DataFrame, queries: DataFrame, size: int = snippets.BEST) -> DataFrame:
    """results with hash and snippet: the best window for rows that hold a term of their text, else an excerpt. Only survivors' values are read into either."""
    plans = planner.planned(queries)
    terms = plans.select("query_id", F.array_distinct(F.concat("every", "some", "fallback")).alias("terms"))
    rows = results.join(entries.select("id", "hash", "value"), "id").join(terms, "query_id")
    held = F.arrays_overlap(F.col("terms"), keyword.tokens("value"))
    found = snippets.with_best_window(rows.filter(held), size=size).drop("terms").unionByName(snippets.with_excerpt(rows.filter(~F.coalesce(held, F.lit(False)))).drop("terms"))
    return found.drop("value")
