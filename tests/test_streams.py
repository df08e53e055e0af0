"""Streams over folders, timers and state that outlives micro-batches."""

import json
import os
import time

import pytest

from lorekeep.streaming import events as ev
from lorekeep.streaming import folders

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def until(check, seconds=90):
    end = time.time() + seconds
    while not check():
        assert time.time() < end, "waited in vain"
        time.sleep(0.2)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(text)


def test_kinds_of_events():
    assert folders.events({"a": "1", "b": "2", "c": "3", "x": "9", "y": "9"}, {"a": "1", "b": "4", "d": "3", "e": "5", "z": "9"}) == [("b", "Changed", None), ("d", "Renamed", "c"), ("e", "Created", None), ("x", "Deleted", None), ("y", "Deleted", None), ("z", "Created", None)]


def test_folder_changes_through_restarts(spark, folder):
    """Three applications of one checkpoint: each event comes once, equal to what the listings' difference says."""
    spark.dataSource.register(folders.FolderChanges)
    top, alone = f"{folder}/watched", f"{folder}/other/one.md"
    for name, text in (("a.md", "one"), ("b.md", "two"), ("deep/c.md", "three"), (".hidden", "no")):
        write(f"{top}/{name}", text)
    write(alone, "single")
    write(f"{folder}/other/sibling.md", "not watched")
    watches = json.dumps({"p": top, "q": alone})
    told = []

    def run(change=None):
        stream = spark.readStream.format("folder_changes").option("watches", watches).option("state", f"{folder}/state").load()
        q = ev.run_mirror(stream, lambda df, n: told[-1].extend((r.project_id, r.path, r.kind, r.old_path) for r in df.collect()), f"{folder}/checkpoint", "0 seconds")
        q.processAllAvailable()
        if change:
            change()
            q.processAllAvailable()
        q.stop()

    told.append([])
    run()
    assert sorted(told[0]) == [("p", f"{top}/{x}", "Created", None) for x in ("a.md", "b.md", "deep/c.md")] + [("q", alone, "Created", None)]

    def second():
        write(f"{top}/b.md", "changed")
        os.rename(f"{top}/a.md", f"{top}/z.md")

    told.append([])
    run(second)
    assert sorted(told[1], key=str) == sorted([("p", f"{top}/b.md", "Changed", None), ("p", f"{top}/z.md", "Renamed", f"{top}/a.md")], key=str)
    os.remove(f"{top}/deep/c.md")  # while nothing runs
    write(f"{top}/n.md", "new")
    os.utime(f"{top}/b.md", (1, 1))  # another time, the same content
    told.append([])
    run()
    assert sorted(told[2], key=str) == sorted([("p", f"{top}/deep/c.md", "Deleted", None), ("p", f"{top}/n.md", "Created", None)], key=str)
    told.append([])
    run()
    assert told[3] == []
    rows = lambda state: spark.createDataFrame(state, "project_id string, path string, mtime long, hash string")
    before, after = rows([("p", "b", 1, "h1"), ("p", "a", 1, "h2"), ("p", "c", 1, "h3")]), rows([("p", "b", 2, "h4"), ("p", "z", 1, "h2"), ("p", "n", 2, "h5")])
    assert sorted((r.path, r.kind, str(r.old_path)) for r in ev.changes(before, after).collect()) == sorted((p, k, str(o)) for p, k, o in folders.events({"b": "h1", "a": "h2", "c": "h3"}, {"b": "h4", "z": "h2", "n": "h5"}))


def test_timed_retries(rocks, folder):
    """Five failures of one watch, each given when its timer has fired, and a failure and a success of another."""
    spark, schema = rocks, "project_id string, watch_path string, seq long, ok boolean"
    given = [("p", "bad", 1, False), ("p", "good", 1, False)]
    spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{folder}/in")
    stream = ev.timed_retries(spark.readStream.schema(schema).parquet(f"{folder}/in"), 300)
    q = stream.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", f"{folder}/c").start()
    rows = lambda **want: [r for r in spark.table("timed").collect() if all(r[k] == v for k, v in want.items())]
    try:
        for seq in (2, 3, 4, 5):
            until(lambda: rows(kind="retry", watch_path="bad", seq=seq - 1))
            new = [("p", "bad", seq, False)] + ([("p", "good", 2, True)] if seq == 2 else [])
            spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            given += new
        until(lambda: rows(kind="result", watch_path="bad", seq=5))
        time.sleep(1)
    finally:
        q.stop()
    want = {(r.watch_path, r.seq): (r.failures, r.status, r.retry_after) for r in ev.retry_states(spark.createDataFrame(given, schema)).collect()}
    assert {(r.watch_path, r.seq): (r.failures, r.status) for r in rows(kind="result")} == {k: v[:2] for k, v in want.items()}
    assert {(r.watch_path, r.seq) for r in rows(kind="retry", watch_path="bad")} == {("bad", n) for n in (1, 2, 3, 4)}  # a stopped watch is not retried
    at = {r.seq: r["at"] for r in rows(kind="result", watch_path="bad")}
    assert all(r["at"] - at[r.seq] == 300 * want["bad", r.seq][2] for r in rows(kind="retry", watch_path="bad"))


def test_a_burst_over_two_batches_is_one_event(rocks, folder):
    spark, schema = rocks, "project_id string, path string, seq long, kind string, old_path string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    put(("p", "a", 1, "Created", None), ("p", "a", 2, "Changed", None), ("p", "b", 3, "Created", None))
    stream = ev.coalesced_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), 6000)
    q = stream.writeStream.format("memory").queryName("burst").outputMode("append").option("checkpointLocation", f"{folder}/c").start()
    try:
        until(lambda: any(p["numInputRows"] == 3 for p in q.recentProgress))
        put(("p", "a", 4, "Renamed", "z"))
        until(lambda: spark.table("burst").count() == 2)
        first = sorted(tuple(r) for r in spark.table("burst").collect())
        put(("p", "a", 5, "Deleted", None))
        until(lambda: spark.table("burst").count() == 3)
    finally:
        q.stop()
    assert first == [("p", "a", 4, "Renamed", "z"), ("p", "b", 3, "Created", None)]
    assert ("p", "a", 5, "Deleted", None) in [tuple(r) for r in spark.table("burst").collect()]
