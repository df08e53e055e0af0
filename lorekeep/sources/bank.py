"""The bank: plain Parquet tables with fixed columns, one folder each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import content_hash
from lorekeep.sources.tables import saved

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ENTRIES = _schema(
    id=_L, hash=_S, path=_S, value=_S, source_file=_S, section=_S, scope=_S, project_id=_S, context_label=_S, workspace_id=_S, agent_id=_S, created_at=_L, updated_at=_L, access_count=_L,
    last_accessed_at=_L, rating=_D, ttl_days=_D, embed_state=_S, embedding=T.ArrayType(T.FloatType()), heading_path=_S, structure_embedding=T.ArrayType(T.FloatType()), chunk_index=_I, total_chunks=_I,
)
TABLES = {
    "entries": ENTRIES,
    "workspaces": _schema(id=_S, project_id=_S, agent_id=_S, status=_S, created_at=_L, closed_at=_L),
    "settings": _schema(key=_S, value=_S),
    "tombstones": _schema(hash=_S, scope=_S, deleted_at=_L),
    "watches": _schema(project_id=_S, path=_S, last_change_ts=_L, lease_owner=_S, lease_until=_L),
    "watch_files": _schema(project_id=_S, path=_S, hash=_S, updated_at=_L),
    "promotion_queue": _schema(project_id=_S, hash=_S, path=_S, value=_S, source_file=_S, score=_D, reasons=T.ArrayType(_S), created_at=_L, updated_at=_L),
}
DEFAULTS = {"access_count": 0, "rating": 0.5, "embed_state": "pending", "chunk_index": 0, "total_chunks": 0}


def conformed(found: DataFrame, table: str) -> DataFrame:
    """found with the table's fixed columns; those that an older version lacks have their defaults, others are left out."""
    missing = [f for f in TABLES[table] if f.name not in found.columns]
    return found.withColumns({f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in missing}).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table]))


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the bank in a folder; one that was never saved is empty."""
    try:
        return conformed(spark.read.parquet(f"{path.rstrip('/')}/{table}"), table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[table])


def save(df: DataFrame, path: str, table: str) -> None:
    """Replace a table of the bank. As df may read the table that it replaces, it is written beside it first; one writer at a time."""
    spark, beside = df.sparkSession, saved(conformed(df, table))
    spark.read.schema(TABLES[table]).parquet(beside).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{table}")


def attached(spark: SparkSession, path: str, *tables: str) -> dict[str, DataFrame]:
    """The tables of another bank, checked: a missing or broken one, or rows against the constraints, are an error."""
    found = {name: conformed(spark.read.parquet(f"{path.rstrip('/')}/{name}"), name) for name in tables}
    if "entries" in found and (bad := violations(found["entries"]).limit(1).collect()):
        raise ValueError(f"{path} holds an entry against the rule: {bad[0]['rule']}")
    return found


def pushed(entries: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a snapshot takes along: no workspace's rows and no settings."""
    return entries.filter("workspace_id IS NULL"), settings.limit(0)


def violations(entries: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Rows that break a constraint: workspace or committed scope, known scope and state, existing workspace; with the rule's name."""
    broken = F.array_compact(F.array(
        F.when(F.col("workspace_id").isNotNull() == F.col("scope").isNotNull(), F.lit("workspace xor scope")),
        F.when(F.col("scope").isNotNull() & ~F.col("scope").isin("shared", "project", "custom"), F.lit("scope")),
        F.when(~F.col("embed_state").isin("pending", "embedded"), F.lit("embed_state")),
    ))
    found = entries.select("id", F.explode(broken).alias("rule"))
    if workspaces is not None:
        orphans = entries.filter("workspace_id IS NOT NULL").join(workspaces.select(F.col("id").alias("workspace_id")), "workspace_id", "left_anti")
        found = found.unionByName(orphans.select("id", F.lit("workspace missing").alias("rule")))
    return found


def sample_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made from the documents and embeddings tables: eight chunks a file, five projects, all scopes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    g = F.expr("doc_id DIV 8")
    path = F.concat(F.lit("docs/"), g, F.lit(".md"))
    return docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("id"), content_hash(path, "text").alias("hash"), path.alias("path"), F.col("text").alias("value"), path.alias("source_file"), F.col("lang").alias("section"),
        F.when(g % 7 == 0, "shared").when(g % 7 == 1, "custom").when(g % 7 > 2, "project").alias("scope"), F.concat(F.lit("p"), g % 5).alias("project_id"),
        F.when(g % 7 == 1, "notes").alias("context_label"), F.when(g % 7 == 2, F.concat(F.lit("w"), g % 5)).alias("workspace_id"),
        (1704067200 + F.col("doc_id") * 3600).alias("created_at"), (F.col("doc_id") % 7).alias("access_count"), F.when(F.col("doc_id") % 3 == 0, 10.0).alias("ttl_days"),
        (0.1 + (F.col("doc_id") % 9) / 10.0).alias("rating"), "embedding", F.when(F.col("embedding").isNull(), "pending").otherwise("embedded").alias("embed_state"), (F.col("doc_id") % 8).cast("int").alias("chunk_index"),
    )
