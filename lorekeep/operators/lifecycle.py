"""Writes, deletes and upkeep of entries, each a function from DataFrames to DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import age_days, content_hash, context_key, rating, written_path

BUCKET = ("path", "hash", "scope", "project_id", "context_label")


def first_of_bucket(rows: DataFrame) -> DataFrame:
    """Keep the earliest row of each bucket: (path, hash) in the shared scope, with project, scope and label elsewhere.

    Workspace rows and rows without path or hash never collide.
    """
    bound = F.col("workspace_id").isNull() & F.col("path").isNotNull() & F.col("hash").isNotNull()
    shared = F.col("scope") == "shared"
    key = Window.partitionBy("path", "hash", "scope", F.when(shared, "").otherwise(F.col("project_id")), F.when(shared, "").otherwise(F.coalesce("context_label", F.lit(""))), F.when(bound, F.lit(-1)).otherwise(F.col("id")))
    return rows.withColumn("place", F.row_number().over(key.orderBy("id"))).filter("place = 1").drop("place")


def numbered(rows: DataFrame) -> DataFrame:
    """Chunks counted from 0 and in total, in each context's file, in the order of id; rows without a file stay as they are."""
    group = Window.partitionBy("ctx", "source_file")
    rows = rows.withColumn("ctx", context_key())
    filed = F.col("source_file").isNotNull()
    return rows.withColumns({"chunk_index": F.when(filed, F.row_number().over(group.orderBy("id")) - 1).otherwise(F.col("chunk_index")).cast("int"), "total_chunks": F.when(filed, F.count("*").over(group)).otherwise(0).cast("int")})


def write(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """What a batch of requests (request_id, project_id, value) would do: each with path, hash, the existing row it meets, and whether it inserts.

    A value that any committed row of the project holds is not written again; of equal requests the first one is. Values meet by their path, which is their digest.
    """
    held = entries.filter("scope IS NOT NULL").groupBy("project_id", written_path("value").alias("path")).agg(F.min("id").alias("existing_id"))
    rows = requests.withColumn("path", written_path("value")).withColumn("hash", content_hash("path", "value"))
    rows = rows.join(held, ["project_id", "path"], "left").withColumn("turn", F.row_number().over(Window.partitionBy("project_id", "path").orderBy("request_id")))
    return rows.withColumn("inserts", F.col("existing_id").isNull() & (F.col("turn") == 1)).drop("turn")


def writable(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Requests with refused: whether they name a workspace that is not an active one of their project."""
    active = workspaces.filter("status = 'Active'").select(F.col("id").alias("workspace_id"), "project_id", F.lit(True).alias("active")).distinct()
    rows = requests.join(active, ["workspace_id", "project_id"], "left")
    return rows.withColumn("refused", F.col("workspace_id").isNotNull() & F.col("active").isNull()).drop("active")


def insert_chunks(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of chunks (path, value and a bucket's columns) that (path, hash, bucket) does not hold yet, of equal new ones the first, with their hash; they are pending."""
    keys = ["path", "hash", *(f"k_{c}" for c in ("scope", "project_id", "context_label", "workspace_id"))]
    named = lambda df: df.select("*", *(F.coalesce(c, F.lit("\0")).alias(f"k_{c}") for c in ("scope", "project_id", "context_label", "workspace_id")))
    rows = named(chunks.withColumn("hash", content_hash("path", "value")))
    fresh = rows.join(named(entries).select(*keys).distinct(), keys, "left_anti")
    first = fresh.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_index"))).filter("place = 1")
    return first.drop("place", *keys[2:]).withColumn("embed_state", F.lit("pending"))


def begin_workspace(project_id: str, agent_id: str, now_ms: int, random_bits: int) -> dict:
    """A new active workspace's row. Its id is a UUID of version 7: the time in milliseconds, then random bits."""
    bits = (now_ms & (1 << 48) - 1) << 80 | 7 << 76 | (random_bits >> 62 & 0xFFF) << 64 | 2 << 62 | random_bits & (1 << 62) - 1
    return {"id": str(uuid.UUID(int=bits)), "project_id": project_id, "agent_id": agent_id, "status": "Active", "created_at": now_ms // 1000, "closed_at": None}


def close_workspace(workspaces: DataFrame, workspace_id: str, now: int) -> DataFrame:
    """Workspaces with an active one closed; a closed one keeps its time."""
    mine = (F.col("id") == workspace_id) & (F.col("status") == "Active")
    return workspaces.withColumns({"closed_at": F.when(mine, F.lit(now).cast("long")).otherwise(F.col("closed_at")), "status": F.when(mine, "Closed").otherwise(F.col("status"))})


def discard_workspace(entries: DataFrame, workspaces: DataFrame, project_id: str, workspace_id: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Entries without the workspace's rows, and workspaces with it closed."""
    inside = (F.col("workspace_id") == workspace_id) & (F.col("project_id") == project_id)
    return entries.filter(~F.coalesce(inside, F.lit(False))), close_workspace(workspaces, workspace_id, now)


def lookup(entries: DataFrame, column: str, value, project_id: str | None = None) -> DataFrame:
    """The first row by id whose id, hash or path is this value, in one project or in all."""
    rows = entries.filter(F.col(column) == value)
    return (rows if project_id is None else rows.filter(F.col("project_id") == project_id)).orderBy("id").limit(1)


def add_content(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose path is not in their bucket yet; an existing path wins even with other content, and of equal new ones the first."""
    keys = [F.coalesce(c, F.lit("\0")).alias(f"k_{c}") for c in ("scope", "project_id", "context_label", "workspace_id")]
    names = ["path", *(f"k_{c}" for c in ("scope", "project_id", "context_label", "workspace_id"))]
    new = rows.select("*", *keys).join(entries.select("path", *keys).distinct(), names, "left_anti")
    return new.withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).filter("place = 1").drop("place", *names[1:])


def share(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Shared copies of project rows that are chosen by (project_id, hash): new path and hash, source and section kept. Paths that are shared already give none."""
    rows = entries.filter("scope = 'project'").join(chosen.select("project_id", "hash").distinct(), ["project_id", "hash"])
    rows = rows.withColumn("path", F.concat(F.lit("shared/"), "path")).withColumn("hash", content_hash("path", "value"))
    rows = rows.withColumns({"scope": F.lit("shared"), "context_label": F.lit(None).cast("string"), "workspace_id": F.lit(None).cast("string")})
    taken = entries.filter("scope = 'shared'").select("path").distinct()
    return rows.join(taken, "path", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("id"))).filter("place = 1").drop("place")


def consolidate_workspace(entries: DataFrame, project_id: str, workspace_id: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows promoted to the project (those of the kept hashes, or of all) without their file, and all rows that the closed workspace discards."""
    inside = entries.filter((F.col("workspace_id") == workspace_id) & (F.col("project_id") == project_id))
    kept = inside if [k.lower() for k in keep] == ["all"] else inside.filter(F.col("hash").isin(*keep) if keep else F.lit(False))
    promoted = kept.withColumns({"scope": F.lit("project"), "workspace_id": F.lit(None).cast("string"), "source_file": F.lit(None).cast("string"), "section": F.lit(None).cast("string")})
    return add_content(entries, promoted), inside


def in_subtree(path: str, column: str = "source_file") -> Column:
    """The path itself or below it; no pattern characters to escape."""
    return (F.col(column) == path) | F.col(column).startswith(path.rstrip("/") + "/")


def delete_subtree(entries: DataFrame, project_id: str, path: str) -> DataFrame:
    """Entries left when a project's committed rows of a path are gone. No tombstones."""
    gone = (F.col("project_id") == project_id) & F.col("scope").isNotNull() & F.coalesce(in_subtree(path), F.lit(False))
    return entries.filter(~gone)


def forget_subtree(fingerprints: DataFrame, project_id: str, path: str) -> DataFrame:
    """Fingerprints (project_id, path, ...) left when those of a path are gone, as delete_subtree's entries are."""
    return fingerprints.filter(~((F.col("project_id") == project_id) & F.coalesce(in_subtree(path, "path"), F.lit(False))))


def in_context(context_key_value: str) -> Column:
    return context_key() == context_key_value


def delete_context(entries: DataFrame, key: str) -> DataFrame:
    """Entries left without a context. No tombstones."""
    return entries.filter(~F.coalesce(in_context(key), F.lit(False)))


def delete_hash(entries: DataFrame, project_id: str, hash_: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Entries left, renumbered, and the tombstones of what has gone; a workspace row leaves none."""
    mine = (F.col("project_id") == project_id) & (F.col("hash") == hash_)
    stones = entries.filter(mine & F.col("scope").isNotNull()).select("hash", "scope", F.lit(now).cast("long").alias("deleted_at")).distinct()
    return numbered(entries.filter(~F.coalesce(mine, F.lit(False)))), stones


def set_ttl(entries: DataFrame, project_id: str, hash_: str, days: float | None) -> DataFrame:
    return entries.withColumn("ttl_days", F.when((F.col("project_id") == project_id) & (F.col("hash") == hash_), F.lit(days).cast("double")).otherwise(F.col("ttl_days")))


def bump_access(entries: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """One access more for the rows whose hash was returned, with their new rating."""
    rows = entries.join(hits.select("hash").distinct().withColumn("hit", F.lit(True)), "hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    more = F.col("access_count") + 1
    return rows.withColumns({"access_count": F.when(F.col("hit"), more).otherwise(F.col("access_count")), "last_accessed_at": F.when(F.col("hit"), F.lit(now)), "rating": F.when(F.col("hit"), rating("created_at", more, now)).otherwise(F.col("rating"))})


def degraded(now: int, threshold: float = 0.3) -> Column:
    """Due for the sweep: a time to live that has passed and a rating below the threshold, both strictly."""
    return F.col("ttl_days").isNotNull() & (F.col("rating") < threshold) & (age_days("created_at", now) > F.col("ttl_days"))


def sweep(entries: DataFrame, project_id: str | None, now: int, threshold: float = 0.3) -> DataFrame:
    """Project rows to sweep whose hash is not shared as well."""
    rows = entries.filter("scope = 'project'") if project_id is None else entries.filter((F.col("scope") == "project") & (F.col("project_id") == project_id))
    return rows.join(entries.filter("scope = 'shared'").select("hash").distinct(), "hash", "left_anti").filter(degraded(now, threshold))


def pending(entries: DataFrame, limit: int) -> DataFrame:
    """The next entries to embed, in the order of id."""
    return entries.filter("embed_state = 'pending'").orderBy("id").limit(limit)


def embed(entries: DataFrame, embedder, dimension_type: str = "array<float>") -> DataFrame:
    """Give pending rows the vectors of `embedder`, a function from a list of texts to a list of vectors that tasks call with Arrow batches."""
    import pyarrow as pa

    columns, kinds = entries.columns, dict(entries.dtypes) | {"embedding": dimension_type}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = pa.array([list(map(float, v)) for v in embedder(batch.column("value").to_pylist())], pa.list_(pa.float32()))
                changed = {"embedding": vectors, "embed_state": pa.array(["embedded"] * batch.num_rows)}
                yield pa.RecordBatch.from_arrays([changed.get(c, batch.column(c)) for c in columns], columns)

    done = entries.filter("embed_state = 'pending'").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return entries.filter("embed_state <> 'pending'").unionByName(done)


def engine_fingerprint(engine: str, model: str, dimensions: int) -> str:
    """What vectors were made with, as a setting keeps it."""
    return f"{engine}|{model}|{dimensions}"


def reembedded(entries: DataFrame, stored: str | None, current: str) -> DataFrame:
    """Entries with all vectors pending again if they were made with another engine."""
    if stored == current:
        return entries
    return entries.withColumns({"embed_state": F.lit("pending"), "embedding": F.lit(None).cast(dict(entries.dtypes)["embedding"])})


def upsert(old: DataFrame, new: DataFrame, *key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both, the new one where keys meet; columns in keep_old stay as they were."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, F.struct(*rest).alias("was")).join(new.select(*key, F.struct(*rest).alias("now")), list(key), "full_outer")
    return both.select(*key, *((F.coalesce(F.col(f"was.{c}"), F.col(f"now.{c}")) if c in keep_old else F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(F.col(f"was.{c}"))).alias(c) for c in rest))


def stats(entries: DataFrame) -> DataFrame:
    """Entries and pending ones of each project."""
    return entries.groupBy("project_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("embed_state") == "pending").alias("n_pending"))
