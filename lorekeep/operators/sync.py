"""Merging two snapshots row by row, with tombstones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.lifecycle import first_of_bucket, numbered

#: What the compatible merge does not carry over from the remote.
_DROPPED = ("source_file", "section", "heading_path")


def _stone_key(df: DataFrame) -> DataFrame:
    return df.withColumn("stone_scope", F.coalesce("scope", F.lit("workspace")))


def merged(local: DataFrame, remote: DataFrame, local_stones: DataFrame, compat: bool = False) -> DataFrame:
    """Local rows and those remote committed rows that are neither locally deleted nor there already. Merged rows are pending and get ids behind the local ones, in their order.

    compat drops the columns that the original merge forgets.
    """
    stones = _stone_key(local_stones).select("hash", "stone_scope").distinct()
    new = _stone_key(remote.filter("workspace_id IS NULL")).join(stones, ["hash", "stone_scope"], "left_anti").drop("stone_scope")
    new = new.withColumns({"embed_state": F.lit("pending"), "embedding": F.lit(None).cast(dict(local.dtypes)["embedding"])})
    if compat:
        new = new.withColumns({c: F.lit(None).cast("string") for c in _DROPPED if c in new.columns})
    # both banks number on their own: one row says how far the remote's numbers have to move
    last, first = local.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id")), remote.agg(F.coalesce(F.min("id"), F.lit(0)).alias("first_id"))
    new = new.join(F.broadcast(last)).join(F.broadcast(first)).withColumn("id", F.col("id") - F.col("first_id") + F.col("last_id") + 1).drop("last_id", "first_id")
    return first_of_bucket(local.unionByName(new))  # the local row is the earlier one of a bucket


def stones_union(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Tombstones of both; the local one where both have it."""
    return local.unionByName(remote.join(local.select("hash", "scope"), ["hash", "scope"], "left_anti"))


def latest_stones(stones: DataFrame) -> DataFrame:
    return stones.filter("scope IS NOT NULL").groupBy("hash", "scope").agg(F.max("deleted_at").alias("deleted_at"))


def apply_stones(entries: DataFrame, stones: DataFrame) -> DataFrame:
    """Entries without those that a tombstone names."""
    keys = stones.select("hash", F.col("scope").alias("stone_scope")).distinct()
    return _stone_key(entries).join(keys, ["hash", "stone_scope"], "left_anti").drop("stone_scope")


def expired(stones: DataFrame, last_pull_at: int | None) -> DataFrame:
    """Tombstones left when those from before the previous pull are dropped."""
    return stones if last_pull_at is None else stones.filter(F.col("deleted_at") >= last_pull_at)


def reindexed(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Embedded committed rows that the remote has as well are pending again."""
    keys = _stone_key(remote).select("hash", "stone_scope").distinct().withColumn("met", F.lit(True))
    rows = _stone_key(local).join(keys, ["hash", "stone_scope"], "left")
    again = F.coalesce("met", F.lit(False)) & (F.col("embed_state") == "embedded") & F.col("workspace_id").isNull()
    return rows.withColumn("embed_state", F.when(again, "pending").otherwise(F.col("embed_state"))).drop("met", "stone_scope")


def merge(local: DataFrame, remote: DataFrame, local_stones: DataFrame, remote_stones: DataFrame, last_pull_at: int | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The whole merge in its order: rows in, tombstones joined, remote deletions applied, old tombstones dropped, met rows re-indexed, chunks counted anew."""
    rows = merged(local, remote, local_stones, compat)
    rows = apply_stones(rows, remote_stones)
    stones = expired(stones_union(local_stones, remote_stones), last_pull_at)
    return numbered(reindexed(rows, remote)), stones


def push(attempt: Callable[[], None], conflict: type[Exception], attempts: int = 3) -> None:
    """Call attempt, which merges again and writes, until no other writer was faster."""
    for left in range(attempts - 1, -1, -1):
        try:
            return attempt()
        except conflict:
            if not left:
                raise
