"""File events: coalescing, routing, fair order, retries; as batch functions and as streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_FAILURES = 5


def coalesced(events: DataFrame) -> DataFrame:
    """The last event of each (project_id, path), by seq."""
    rest = [c for c in events.columns if c not in ("project_id", "path")]
    return events.groupBy("project_id", "path").agg(F.max_by(F.struct(*rest), "seq").alias("last")).select("project_id", "path", "last.*")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events (project_id, path, kind, old_path) between two listings (project_id, path, mtime, hash) of watched folders.

    A file that has gone and one of the same hash that has come in the same project are a rename, if neither side has several of them; a file that was renamed
    to where nothing is watched has no partner and is deleted.
    """
    both = before.select("project_id", "path", F.struct("mtime", "hash").alias("was")).join(after.select("project_id", "path", F.struct("mtime", "hash").alias("now")), ["project_id", "path"], "full_outer")
    kinds = both.withColumn("kind", F.when(F.col("was").isNull(), "Created").when(F.col("now").isNull(), "Deleted").when(F.col("was.hash") != F.col("now.hash"), "Changed"))
    one = lambda kind, side: kinds.filter(F.col("kind") == kind).groupBy("project_id", F.col(f"{side}.hash").alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias(side)).filter("n = 1").drop("n")
    renamed = one("Deleted", "was").join(one("Created", "now"), ["project_id", "hash"]).select("project_id", F.col("now").alias("path"), F.col("was").alias("old_path"))
    rest = kinds.filter("kind IS NOT NULL").join(renamed.select("project_id", "path").unionByName(renamed.select("project_id", F.col("old_path").alias("path"))), ["project_id", "path"], "left_anti")
    return rest.select("project_id", "path", "kind", F.lit(None).cast("string").alias("old_path")).unionByName(renamed.select("project_id", "path", F.lit("Renamed").alias("kind"), "old_path"))


def prefixes(path: str) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def routed(events: DataFrame, watches: DataFrame) -> DataFrame:
    """Each event with the most specific watch that holds its path; others are dropped.

    An event's own folders are exploded and joined by equality, so no watch is compared with every event.
    """
    spots = events.select("*", F.explode(prefixes("path")).alias("watch_path")).join(watches.select("project_id", F.col("path").alias("watch_path")), ["project_id", "watch_path"])
    keys = events.columns
    return spots.groupBy(*keys).agg(F.max_by("watch_path", F.length("watch_path")).alias("watch_path"))


def fair_order(jobs: DataFrame) -> DataFrame:
    """Jobs (project_id, watch_path, seq) of each project in rounds over its watches, a watch's first job giving its turn."""
    own = Window.partitionBy("project_id", "watch_path")
    rows = jobs.withColumn("round", F.row_number().over(own.orderBy("seq"))).withColumn("turn", F.min("seq").over(own))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("round", "turn"))).drop("turn")


def digest_actions(events: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """What to do for each event: rename (drop the old path first), delete, touch (same hash) or replace. content_hash is NULL for a file that is not there."""
    rows = events.join(fingerprints.select("project_id", "path", F.col("hash").alias("known_hash")), ["project_id", "path"], "left")
    gone = (F.col("kind") == "Deleted") | F.col("content_hash").isNull()
    return rows.withColumn("action", F.when(gone, "delete").when(F.col("content_hash") == F.col("known_hash"), "touch").otherwise("replace")).withColumn("drop_path", F.when(F.col("kind") == "Renamed", F.col("old_path")))


def mirrored(fingerprints: DataFrame, actions: DataFrame, now: int) -> DataFrame:
    """Fingerprints after the actions."""
    gone = actions.filter("action = 'delete'").select("project_id", "path").unionByName(actions.filter("drop_path IS NOT NULL").select("project_id", F.col("drop_path").alias("path"))).distinct()
    fresh = actions.filter("action <> 'delete'").select("project_id", "path", F.col("content_hash").alias("hash"), F.lit(now).cast("long").alias("updated_at"))
    rest = fingerprints.join(gone, ["project_id", "path"], "left_anti").join(fresh.select("project_id", "path"), ["project_id", "path"], "left_anti")
    return rest.select("project_id", "path", "hash", "updated_at").unionByName(fresh)


def after_result(failures: int, ok: bool, stopped: bool) -> tuple[int, str]:
    """Failures in a row and status: four failures are retried after 1, 2, 4 and 8 seconds, the fifth stops the watch."""
    if stopped:
        return failures, "Stopped"
    failures = 0 if ok else failures + 1
    return failures, "Healthy" if ok else "Stopped" if failures >= MAX_FAILURES else "Retrying"


def retry_states(results: DataFrame) -> DataFrame:
    """For each result (project_id, watch_path, seq, ok) the state after it, with windows only: failures since the last success, until the first stop."""
    own = Window.partitionBy("project_id", "watch_path").orderBy("seq")
    rows = results.withColumn("spell", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(own))
    rows = rows.withColumn("run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("project_id", "watch_path", "spell").orderBy("seq")))
    stop = F.min(F.when(F.col("run") >= MAX_FAILURES, F.col("seq"))).over(Window.partitionBy("project_id", "watch_path"))
    rows = rows.withColumn("stop", stop)
    stopped = F.coalesce(F.col("seq") >= F.col("stop"), F.lit(False))
    failures = F.when(stopped, MAX_FAILURES).otherwise(F.col("run"))
    return rows.select("project_id", "watch_path", "seq", failures.cast("int").alias("failures"), F.when(stopped, "Stopped").when(F.col("ok"), "Healthy").otherwise("Retrying").alias("status"), F.when(~stopped & ~F.col("ok"), F.pow(F.lit(2), F.col("run") - 1)).cast("long").alias("retry_after"))


def watch_status(results: DataFrame) -> DataFrame:
    """The state of each watch after its results (project_id, watch_path, seq, ok, at, error): status, failures, last_error and last_sync, the time of its last success."""
    last = retry_states(results).groupBy("project_id", "watch_path").agg(F.max_by(F.struct("status", "failures"), "seq").alias("last"))
    seen = results.groupBy("project_id", "watch_path").agg(F.max_by("error", F.when(~F.col("ok"), F.col("seq"))).alias("last_error"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_sync"))
    return last.join(seen, ["project_id", "watch_path"]).select("project_id", "watch_path", "last.status", "last.failures", "last_error", "last_sync")


def watch_listing(watches: DataFrame, states: DataFrame) -> DataFrame:
    """All registered watches with their state; one without any is still scanning."""
    rows = watches.join(states.withColumnRenamed("watch_path", "path"), ["project_id", "path"], "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("Scanning")), "failures": F.coalesce("failures", F.lit(0))})


def advanced(watches: DataFrame, digested: DataFrame, now: int) -> DataFrame:
    """Watches with last_change_ts moved to the time of processing where a file of theirs (project_id, watch_path) was digested."""
    met = digested.select("project_id", F.col("watch_path").alias("path")).distinct().withColumn("met", F.lit(True))
    return watches.join(met, ["project_id", "path"], "left").withColumn("last_change_ts", F.when(F.col("met"), F.lit(now).cast("long")).otherwise(F.col("last_change_ts"))).drop("met")


def admitted(jobs: DataFrame, running: DataFrame, gates: DataFrame) -> DataFrame:
    """Of the jobs in fair_order() those that start now: as many of each project as its gate (4, or what is set from 1 to 16) leaves beside the running ones (project_id, n)."""
    gate = F.least(F.lit(16), F.greatest(F.lit(1), F.coalesce("gate", F.lit(4))))
    rows = jobs.join(gates.select("project_id", "gate"), "project_id", "left").join(running.select("project_id", F.col("n").alias("busy")), "project_id", "left")
    return rows.filter(F.col("place") <= gate - F.coalesce("busy", F.lit(0))).drop("gate", "busy")


def reconciled(wanted: DataFrame, running: DataFrame) -> DataFrame:
    """What a loop has to do to each watch (project_id, path): start what is wanted and does not run, stop what runs and is not wanted, keep the rest."""
    both = wanted.select("project_id", "path", F.lit(True).alias("w")).distinct().join(running.select("project_id", "path", F.lit(True).alias("r")).distinct(), ["project_id", "path"], "full_outer")
    return both.select("project_id", "path", F.when(F.col("r").isNull(), "start").when(F.col("w").isNull(), "stop").otherwise("keep").alias("action"))


def each_project(project_ids: list[str], step: Callable[[str], None]) -> dict[str, str | None]:
    """Call step for each project; one project's failure is its result and does not keep the others."""
    done: dict[str, str | None] = {}
    for project in project_ids:
        try:
            step(project)
            done[project] = None
        except Exception as e:  # noqa: BLE001  what failed is told by project
            done[project] = f"{type(e).__name__}: {e}"
    return done


def run_extraction(spark: SparkSession, project_ids: Callable[[], list[str]], step: Callable[[str], None], tell: Callable[[dict], None], checkpoint: str, every: str = "30 minutes"):
    """Start the extraction loop: at each trigger step runs for all projects of that time, and tell gets what became of each."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda _, n: tell(each_project(project_ids(), step))).start()


def stream_retry_states(results: DataFrame) -> DataFrame:
    """The same over a stream, with the state of each watch kept between micro-batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, stopped = state.get if state.exists else (0, False)
        out = []
        for frame in frames:
            for seq, ok in frame.sort_values("seq")[["seq", "ok"]].itertuples(index=False):
                failures, status = after_result(failures, bool(ok), stopped)
                stopped = status == "Stopped"
                out.append((key[0], key[1], seq, failures, status))
        state.update((failures, stopped))
        yield pd.DataFrame(out, columns=["project_id", "watch_path", "seq", "failures", "status"])

    return results.groupBy("project_id", "watch_path").applyInPandasWithState(step, "project_id string, watch_path string, seq long, failures int, status string", "failures int, stopped boolean", "append", "NoTimeout")


class _Retries(StatefulProcessor):
    """The state of one watch; a failure that is retried sets a timer, which tells when the time has come."""

    def __init__(self, unit_ms: int):
        self.unit_ms = unit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures int, stopped boolean, seq long")

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, *r) for r in rows], columns=["project_id", "watch_path", "kind", "seq", "failures", "status", "at"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, stopped, _ = self.state.get() if self.state.exists() else (0, False, 0)
        now, out, seq = timerValues.getCurrentProcessingTimeInMs(), [], 0
        for frame in rows:
            for seq, ok in frame.sort_values("seq")[["seq", "ok"]].itertuples(index=False):
                failures, status = after_result(failures, bool(ok), stopped)
                stopped = status == "Stopped"
                out.append(("result", int(seq), failures, status, now))
        self.state.update((failures, stopped, int(seq)))
        for timer in list(self.handle.listTimers()):  # what was due before this result is so no more
            self.handle.deleteTimer(timer)
        if failures and not stopped:
            self.handle.registerTimer(now + self.unit_ms * 2 ** (failures - 1))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, _, seq = self.state.get()
        yield from self._rows(key, [("retry", seq, failures, "Retrying", expiredTimerInfo.getExpiryTimeInMs())])

    def close(self) -> None:
        pass


def timed_retries(results: DataFrame, unit_ms: int = 1000) -> DataFrame:
    """A stream of results (project_id, watch_path, seq, ok) as rows of kind result, with the state after each, and of kind retry when a failed watch is due again: 1, 2, 4 and 8 units after its failure.

    The session needs the RocksDB state store. A stopped watch is not retried, nor one that has had another result meanwhile.
    """
    return results.groupBy("project_id", "watch_path").transformWithStateInPandas(_Retries(unit_ms), "project_id string, watch_path string, kind string, seq long, failures int, status string, at long", "append", "processingTime")


class _LastOfTick(StatefulProcessor):
    """The last event of one path, until the tick after it."""

    def __init__(self, tick_ms: int, schema: T.StructType):
        self.tick_ms, self.schema = tick_ms, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        at = names.index("seq")
        last = tuple(self.last.get()) if self.last.exists() else None
        for frame in rows:
            newest = frame.loc[frame["seq"].idxmax(), names]
            if last is None or newest["seq"] > last[at]:
                last = tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in newest.tolist())
        self.last.update(last)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick_ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get())
        self.last.clear()
        yield pd.DataFrame([last], columns=self.schema.fieldNames())

    def close(self) -> None:
        pass


def coalesced_stream(events: DataFrame, tick_ms: int = 1000) -> DataFrame:
    """A stream of events (project_id, path, seq and others) with only the last event of each path and tick, whatever micro-batches they came in. The session needs the RocksDB state store."""
    return events.groupBy("project_id", "path").transformWithStateInPandas(_LastOfTick(tick_ms, events.schema), events.schema, "append", "processingTime")


def run_mirror(events: DataFrame, digest: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Start the mirror: in each micro-batch the last event of each path goes to digest(events, batch_id)."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda batch, n: digest(coalesced(batch), n)).start()


def free_lease(owner: str, now: int) -> Column:
    """Whether a watch's scan may be taken: nobody's, one's own, or run out."""
    return F.col("lease_owner").isNull() | (F.col("lease_owner") == owner) | (F.col("lease_until") < now)


def leased(watches: DataFrame, owner: str, now: int, ttl: int = 60) -> DataFrame:
    free = free_lease(owner, now)
    return watches.withColumns({"acquired": free, "lease_owner": F.when(free, F.lit(owner)).otherwise(F.col("lease_owner")), "lease_until": F.when(free, F.lit(now + ttl)).otherwise(F.col("lease_until"))})


def resolved_settings(settings: DataFrame, projects: DataFrame, name: str, default: str) -> DataFrame:
    """A setting of each project: its own, else the global one, else the default."""
    own = settings.filter(F.col("key").startswith(f"{name}.project:")).select(F.expr(f"substring(key, {len(name) + 10})").alias("project_id"), F.col("value").alias("own"))
    common = settings.filter(F.col("key") == f"{name}.global").agg(F.max("value").alias("common"))
    return projects.join(own, "project_id", "left").join(F.broadcast(common)).select("project_id", F.coalesce("own", "common", F.lit(default)).alias("value"))
