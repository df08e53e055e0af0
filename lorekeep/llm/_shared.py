"""Helpers that several operators of this folder use.

Everything here works on Arrow batches inside tasks or on DataFrame plans; nothing gathers rows on the driver.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that one step of a task works on, and powers of the hash's base that a worker keeps.
PIECE = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or these of its columns."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share, which the cluster names in spark.checkpoint.dir.

    Where that is unset a local folder is made, but only if driver and executors are one process; elsewhere it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/lorekeep-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage is cut, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df, with Spark no longer knowing that it is partitioned by key.

    A join then shuffles both its sides itself, which lets adaptive execution split a hot key.
    """
    return df.withColumn(key, F.col(key).bitwiseOR(F.lit(0).cast("long")))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null one is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def slices(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of an Arrow text column, their bytes and offsets, in pieces of about limit bytes; a longer text is a piece of its own."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def decoded(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, list[str]]]:
    """Rows lo to hi of an Arrow text column as strings, in pieces of about limit bytes."""
    for lo, hi, _, _ in slices(column, limit):
        yield lo, hi, [x.decode() for x in texts(column.slice(lo, hi - lo))]


#: What workers keep between tasks, by the function that drops it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, made to leave room in a worker, which lives on: what other tasks have kept is dropped at its start, and unused memory given back at its end."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in KEPT.items():
            if name != keeps:
                drop()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return done


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, of which those for a PIECE are kept."""

    def first(base: np.uint64, n: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    if n > PIECE + 1:
        return first(_BASE, n), first(_INVERSE, n)
    if not _POWERS:
        _POWERS.update(up=first(_BASE, PIECE + 1), down=first(_INVERSE, PIECE + 1))
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum of a polynomial."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each window of so many words, in text order. A text with fewer words is one window; one without words has none."""
    starts, ends, doc = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = span_hashes(data, starts, ends)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    left = begin[doc + 1] - np.arange(len(doc))  # words from here to the end of the text
    first = np.arange(len(doc)) == begin[doc]
    keep = np.flatnonzero((left >= words) | first & (counts[doc] < words))
    out = np.zeros(len(keep), np.uint64)
    for k in range(words):
        at = np.minimum(keep + k, len(each) - 1)
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(k < left[keep], each[at], np.uint64(0))
        out ^= out >> np.uint64(32)
    return mixed(out), doc[keep]


def run_tables(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys in batches sorted by them; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            x = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        new[0] = bool(held) and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo and held or lo == 0 and new[0] and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
