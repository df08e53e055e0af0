"""Files as a source: directory ingest, catch-up scans, and what may be ingested."""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from fnmatch import translate
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEXABLE = r"(?i)\.(md|markdown|txt)$"


def scope_table(scopes: list[str]) -> list[str]:
    """Scopes with links resolved, in order, without those that lie under another: a path is in scope if the last of them that is not behind it is a prefix of it."""
    out: list[str] = []
    for top in sorted({os.path.realpath(x).rstrip("/") + "/" for x in scopes}):
        if not out or not top.startswith(out[-1]):
            out.append(top)
    return out


def in_scope(path: str, scopes: list[str], table: list[str] | None = None) -> bool:
    """Whether a path, symbolic links resolved, is a scope or lies under one. No scope allows nothing."""
    table = scope_table(scopes) if table is None else table
    real = os.path.realpath(path).rstrip("/") + "/"
    at = bisect_right(table, real)
    return at > 0 and real.startswith(table[at - 1])


def scoped(files: DataFrame, scopes: list[str]) -> DataFrame:
    """files with in_scope: their paths are resolved and held against the scopes in the tasks, where the files are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scope_table(scopes)
        for batch in batches:
            held = pa.array([p is not None and in_scope(p, [], table) for p in batch.column("path").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, held], [*batch.schema.names, "in_scope"])

    return files.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in files.dtypes), "in_scope boolean"]))


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """path and mtime of the indexable files below a directory; names that start with a dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_seconds("modificationTime").alias("mtime"))
    return files.filter(F.col("path").rlike(INDEXABLE) & ~F.substring_index("path", "/", -1).startswith("."))


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """path and text of the indexable files, whole."""
    files = spark.read.text(directory, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.col("value").alias("text"))
    return files.filter(F.col("path").rlike(INDEXABLE) & ~F.substring_index("path", "/", -1).startswith("."))


def globbed(paths: DataFrame, include: list[str], exclude: list[str] = []) -> DataFrame:
    """Paths that some include pattern matches and no exclude pattern does."""
    some = lambda patterns: reduce(lambda a, b: a | b, (F.col("path").rlike(translate(x)) for x in patterns), F.lit(False))
    return paths.filter(some(include) & ~some(exclude))


def classified(paths: DataFrame, rules: list[tuple[str, str, str | None]], default: tuple[str, str | None] = ("doc", None)) -> DataFrame:
    """Paths with kind and context_label by the first rule (prefix, kind, label) whose prefix they have."""
    pick = lambda k: reduce(lambda out, rule: F.when(F.col("path").startswith(rule[0]), F.lit(rule[k])).otherwise(out), reversed(rules), F.lit(default[k - 1])).cast("string")
    return paths.withColumns({"kind": pick(1), "context_label": pick(2)})


def tree(paths: DataFrame) -> DataFrame:
    """The nodes of the tree that paths make: (parent, name, is_folder). What is both a file and a folder is a folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("parent"), F.get(parts, n - 1).alias("name"), (n < F.size(parts)).alias("is_folder")))
    return paths.select(F.explode(above).alias("x")).groupBy("x.parent", "x.name").agg(F.max("x.is_folder").alias("is_folder"))


def tree_json(paths: DataFrame) -> DataFrame:
    """(project_id, tree) of paths (project_id, path): one JSON object for each project, nested by folders, names in the order of their bytes, {} for a file. What is both a file and a folder is a folder.

    Folded from the deepest level up, one aggregation a level; a folder's names meet in one row, as they do in the result.
    """
    parts = F.split("path", "/")
    nodes = paths.select("project_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))).alias("node")).distinct()
    nodes = nodes.select("project_id", F.size("node").alias("depth"), F.array_join(F.slice("node", F.lit(1), F.size("node") - 1), "/").alias("parent"), F.array_join("node", "/").alias("node"), F.element_at("node", -1).alias("name"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        level = nodes.filter(F.col("depth") == depth)
        level = level.withColumn("inner", F.lit("{}")) if below is None else level.join(below.withColumnRenamed("parent", "node"), ["project_id", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit("{}")))
        quoted = F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", "")
        listed = F.array_sort(F.collect_list(F.struct("name", F.concat(quoted, F.lit(":"), "inner").alias("text"))))
        below = level.groupBy("project_id", "parent").agg(F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda x: x["text"]), ","), F.lit("}")).alias("inner"))
    return paths.select("project_id").limit(0).withColumn("tree", F.lit("")) if below is None else below.select("project_id", F.col("inner").alias("tree"))


def verdicts(files: DataFrame, scopes: list[str]) -> DataFrame:
    """files with verdict: outside (of all scopes), else unsupported (by its name), else ok. The scope is looked at first."""
    return scoped(files, scopes).withColumn("verdict", F.when(~F.col("in_scope"), "outside").when(~F.coalesce(F.col("path").rlike(INDEXABLE), F.lit(False)), "unsupported").otherwise("ok")).drop("in_scope")


def ingestable(files: DataFrame, scopes: list[str]) -> DataFrame:
    """Files (path, text) that may be ingested, in the order of their paths."""
    return verdicts(files, scopes).filter("verdict = 'ok'").drop("verdict").orderBy("path")


def ingest_results(files: DataFrame, scopes: list[str], inserted: DataFrame) -> DataFrame:
    """(path, verdict, n) for each file: n is 1 if rows of it (inserted, by source_file) were new, else 0."""
    met = inserted.select(F.col("source_file").alias("path")).distinct().withColumn("met", F.lit(1))
    return verdicts(files, scopes).join(met, "path", "left").select("path", "verdict", F.when((F.col("verdict") == "ok") & (F.col("met") == 1), 1).otherwise(0).alias("n"))


def moved_scopes(settings: DataFrame, old: str, new: str) -> DataFrame:
    """Settings with keys under the prefix old put under new; where the new key is there already it stays as it is."""
    mine = F.col("key").startswith(old)
    moved = settings.filter(mine).withColumn("key", F.concat(F.lit(new), F.expr(f"substring(key, {len(old) + 1})")))
    rest = settings.filter(~mine)
    return rest.unionByName(moved.join(rest.select("key"), "key", "left_anti"))


def due(files: DataFrame, fingerprints: DataFrame, watermark: int | None) -> DataFrame:
    """Files to digest: all without a watermark, else those changed after it or never fingerprinted."""
    if watermark is None:
        return files
    late = files.filter(F.col("mtime") > watermark)
    return late.unionByName(files.filter(F.col("mtime") <= watermark).join(fingerprints.select("path"), "path", "left_anti"))


def vanished(fingerprints: DataFrame, files: DataFrame, below: str) -> DataFrame:
    """Fingerprinted paths under a watch that are no longer there."""
    return fingerprints.filter((F.col("path") == below) | F.col("path").startswith(below.rstrip("/") + "/")).join(files.select("path"), "path", "left_anti")
