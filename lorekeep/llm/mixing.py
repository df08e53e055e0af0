"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed for each source, each source gets a target and from it a repetition rate, and every document is
emitted floor(rate) times plus one Bernoulli copy, drawn from a hash of its doc_id, with the fraction as probability.

Defined results: a null text has size 0; null sources are one source, the last; a source without words has rate 0 and
its documents are not emitted; a null doc_id draws as the empty string; repeated rows draw alike; an empty table
gives an empty result; other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm._shared import WORD, documents, stash

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes; the most that a target may be, as a multiple of its source's size.
SHARE, CAP = 1.5, 2.0
#: Most rows of the table of sources that is broadcast; a larger one is joined by shuffles.
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on doc_id and seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From rows (source, size): source, source_size, target and rate.

    Targets are the level of a common filling: a source takes level * weight, but at most cap * size. With sources in
    the order of cap * size / weight, a source is full exactly if the level left by those before it reaches it, so two
    running sums settle what sharing the excess again and again would. These windows see one row per source.
    """
    everything = Window.partitionBy()
    filling = Window.orderBy("full_at", "number").rowsBetween(Window.unboundedPreceding, -1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("room", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("room") / F.col("weight"))
    per = per.withColumns({"all": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything), "room_before": F.coalesce(F.sum("room").over(filling), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(filling), F.lit(0.0))})
    per = per.withColumn("full", (F.lit(share) * F.col("all") - F.col("room_before")) / (F.col("weights") - F.col("weight_before")) >= F.col("full_at"))
    per = per.withColumns({"room_full": F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(everything), "weight_left": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)})
    level = (F.lit(share) * F.col("all") - F.col("room_full")) / F.col("weight_left")
    target = F.when(F.col("full"), F.col("room")).otherwise(level * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _joined(rows: DataFrame, targets: DataFrame, source: Column) -> DataFrame:
    targets = stash(targets).withColumnRenamed("source", "mix_source")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(targets) if few else targets, source.eqNullSafe(F.col("mix_source")))


def copies(rate: Column, doc_id: str = "doc_id", seed: str = SEED) -> Column:
    return (F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """For each document its size, its source's size and target, its copies and the words they take."""
    sizes = stash(docs.select("doc_id", "source", size_of().alias("size")))
    rows = _joined(sizes, source_targets(sizes), F.col("source")).withColumn("copies", copies(F.col("rate"), seed=seed))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents of the mix: the columns of docs, each row as often as its copies."""
    targets = source_targets(docs.select("source", size_of().alias("size")))
    rows = docs.select(F.struct("*").alias("document"))
    rows = _joined(rows, targets, F.col("document.source")).select("document", copies(F.col("rate"), "document.doc_id", seed).alias("copies"))
    return rows.filter("copies > 0").select("document", F.explode(F.sequence(F.lit(1), "copies"))).select("document.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM sizes GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][number % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS room FROM per),
filled AS (SELECT *, room / weight AS full_at, sum(source_size) OVER () AS all_sizes, sum(weight) OVER () AS weights,
    coalesce(sum(room) OVER w, 0.0) AS room_before, coalesce(sum(weight) OVER w, 0.0) AS weight_before
  FROM weighed WINDOW w AS (ORDER BY room / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
told AS (SELECT *, (1.5::DOUBLE * all_sizes - room_before) / (weights - weight_before) >= full_at AS is_full FROM filled),
levels AS (SELECT *, (1.5::DOUBLE * all_sizes - sum(CASE WHEN is_full THEN room ELSE 0.0 END) OVER ()) / sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER () AS level FROM told),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN room ELSE level * weight END AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn
"""
