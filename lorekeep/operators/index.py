"""The keyword index: a kept folder of segments, brought up to date by deltas.

Entries are numbered in segments of up to SEGMENT. A segment is a run of rows: a header (term is NULL) with its entries' ids, contexts, lengths and digests, and a row for
each term with the places of the entries that hold it, how often it stands in each column, and all its spots (place, column and position in one number). A row's
terms never leave the task that reads it: nothing is shuffled to build an index.

Each update is one generation: the segments of new and changed entries, the places of earlier segments that they or deletions replace, and a commit with the
sums that they add to the number of entries and of tokens. A reader sees committed generations only. After MOST_GENERATIONS, or when more is replaced than alive, the index is
made anew under a new base.

Entries: (id, value, source_file, section), and ctx if contexts are searched. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens
from lorekeep.sources.tables import exists, shared_folder, stash

COLUMNS = ("value", "source_file", "section")
#: Entries of a segment, and tokens after which it ends early.
SEGMENT, SEGMENT_TOKENS = 2048, 2_000_000
MOST_GENERATIONS = 16
#: A spot is (place * columns + column) * 2**SHIFT + position.
SHIFT = 32
_ROW = "segment long, term string, n int, tokens long, ids array<long>, ctxs array<string>, lengths array<int>, digests array<long>, places array<int>, f_value array<int>, f_source_file array<int>, f_section array<int>, spots array<long>"
_FIELDS = [x.split()[0] for x in _ROW.split(", ")]
#: Part of the name of kept indexes: another one for each change of what is kept or of how texts are cut into tokens.
FORMAT = 2
#: A segment's number is its generation, the task that made it and its place among that task's, from these bits on.
_GENERATION, _TASK = 52, 28
_DEAD, _COMMIT = "gen long, segment long, place int", "gen long, base long, entries long, tokens long, segments long"


@dataclass(frozen=True)
class Index:
    """rows: the segments; dead: (segment, place) of replaced entries, or None; entries, tokens: how many are alive; segments: how many there are."""

    rows: DataFrame
    dead: DataFrame | None
    entries: int
    tokens: int
    segments: int

    @property
    def mean(self) -> float:
        return self.tokens / self.entries if self.entries and self.tokens else 1.0

    def lists(self) -> DataFrame:
        return self.rows.filter("term IS NOT NULL")

    def headers(self) -> DataFrame:
        return self.rows.filter("term IS NULL")

    def alive(self) -> DataFrame:
        """(segment, place, id, ctx, length, digest) of the entries."""
        each = F.posexplode(F.arrays_zip("ids", "ctxs", "lengths", "digests"))
        found = self.headers().select("segment", each.alias("place", "x")).select("segment", "place", F.col("x.ids").alias("id"), F.col("x.ctxs").alias("ctx"), F.col("x.lengths").alias("length"), F.col("x.digests").alias("digest"))
        return found if self.dead is None else found.join(self.dead, ["segment", "place"], "left_anti")


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def segment_rows(table: pa.Table, number: int) -> pa.RecordBatch:
    """A segment's rows from entries (id, ctx, digest, t_value, t_source_file, t_section)."""
    n = table.num_rows
    words, spots = [], []
    for c, name in enumerate(COLUMNS):
        column = table.column(f"t_{name}").combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), sizes)
        words.append(column.flatten())
        spots.append((row * len(COLUMNS) + c << SHIFT) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    coded = pa.chunked_array(words, pa.string()).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    code, spot = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(spots)
    order = np.lexsort((spot, code))
    code, spot = code[order], spot[order]
    column, row = (spot >> SHIFT) % len(COLUMNS), (spot >> SHIFT) // len(COLUMNS)
    new_term = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
    new_entry = new_term | np.append(True, row[1:] != row[:-1]) if len(code) else new_term
    terms, entries = np.flatnonzero(new_term), np.flatnonzero(new_entry)
    counts = [np.add.reduceat(column == c, entries) if len(entries) else np.zeros(0, np.int64) for c in range(len(COLUMNS))]
    of_entry = np.append(np.searchsorted(entries, terms), len(entries))  # where each term's entries begin
    lengths = np.bincount(row, minlength=n)
    head = {"segment": [number], "term": [None], "n": [n], "tokens": [len(code)], "ids": [table.column("id").to_pylist()], "ctxs": [table.column("ctx").to_pylist()], "lengths": [lengths.tolist()], "digests": [table.column("digest").to_pylist()]}
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]
    schema = pa.schema(list(zip(_FIELDS, kinds)))
    many = len(terms)
    body = [
        pa.array(np.full(many, number)), coded.dictionary.take(pa.array(code[terms])) if many else pa.array([], pa.string()), pa.array(np.diff(of_entry).astype(np.int32)), pa.array(np.diff(np.append(terms, len(code)))), *(pa.nulls(many, k) for k in kinds[4:8]),
        _lists(of_entry, row[entries].astype(np.int32), pa.int32()), *(_lists(of_entry, x.astype(np.int32), pa.int32()) for x in counts), _lists(np.append(terms, len(code)), spot, pa.int64()),
    ]
    both = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(head.get(f, [None]), k) for f, k in zip(_FIELDS, kinds)], schema=schema), pa.RecordBatch.from_arrays(body, schema=schema)])
    return both.combine_chunks().to_batches()[0]


def digested(entries: DataFrame) -> DataFrame:
    """entries with ctx and a digest of all that the index keeps of them."""
    rows = entries if "ctx" in entries.columns else entries.withColumn("ctx", F.lit(None).cast("string"))
    return rows.select(F.col("id").cast("long").alias("id"), "ctx", *COLUMNS, F.xxhash64("ctx", *(F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("")) for c in COLUMNS)).alias("digest"))


def segments(entries: DataFrame, generation: int) -> DataFrame:
    """The segments of digested entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, words = (generation << _GENERATION) + (TaskContext.get().partitionId() << _TASK), [], 0, 0
        for batch in batches:
            total = np.cumsum(sum(pc.fill_null(pc.list_value_length(batch.column(f"t_{c}")), 0).to_numpy(zero_copy_only=False) for c in COLUMNS)) if batch.num_rows else np.zeros(0)
            lo = 0
            while lo < batch.num_rows:
                before = total[lo - 1] if lo else 0
                hi = min(lo + SEGMENT - size, max(lo + 1, int(np.searchsorted(total, before + SEGMENT_TOKENS - words, "right"))), batch.num_rows)
                held.append(batch.slice(lo, hi - lo))
                size, words, lo = size + hi - lo, words + int(total[hi - 1] - before), hi
                if size >= SEGMENT or words >= SEGMENT_TOKENS or lo < batch.num_rows:
                    yield segment_rows(pa.Table.from_batches(held), number)
                    number, held, size, words = number + 1, [], 0, 0
        if held:
            yield segment_rows(pa.Table.from_batches(held), number)

    if len(entries.inputFiles()) < entries.sparkSession.sparkContext.defaultParallelism:  # a table of few files would be read by few tasks
        entries = entries.repartition(entries.sparkSession.sparkContext.defaultParallelism)
    return entries.select("id", "ctx", "digest", *(tokens(c).alias(f"t_{c}") for c in COLUMNS)).mapInArrow(run, _ROW)


def dealt(stripes: int) -> Column:
    """The stripe of a segment. Segments that are the n-th of their tasks lie evenly on the stripes, since tasks have consecutive numbers; each n begins elsewhere."""
    nth = F.hash(F.col("segment").bitwiseAND(F.lit((1 << _TASK) - 1)))
    return F.pmod(F.shiftright("segment", _TASK) + nth, F.lit(stripes)).cast("int")


def _commits(spark: SparkSession, path: str) -> list:
    return sorted(spark.read.schema(_COMMIT).parquet(f"{path}/commits").collect()) if exists(spark, f"{path}/commits") else []  # one row for each update


def read(spark: SparkSession, path: str) -> Index | None:
    """The index in a folder, as committed; None where there is none."""
    commits = _commits(spark, path)
    if not commits:
        return None
    base = commits[-1]["base"]
    live = [c for c in commits if c["base"] == base]
    gens = [c["gen"] for c in live]
    rows = spark.read.schema(_ROW).parquet(*(f"{path}/segments/gen={g}" for g in gens))
    dead = spark.read.schema(_DEAD).parquet(*(f"{path}/dead/gen={g}" for g in gens[1:])).select("segment", "place") if len(gens) > 1 else None
    return Index(rows, dead, sum(c["entries"] for c in live), sum(c["tokens"] for c in live), sum(c["segments"] for c in live))


def _commit(spark: SparkSession, path: str, gen: int, base: int, entries: int, words: int, segments_: int) -> None:
    spark.createDataFrame([(gen, base, entries, words, segments_)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _sums(rows: DataFrame) -> tuple[int, int, int]:
    """Entries, tokens and segments."""
    return tuple(map(int, rows.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()))


def build(entries: DataFrame, path: str) -> Index:
    """Make the index of entries anew, as a new base."""
    spark = entries.sparkSession
    gen = max((c["gen"] for c in _commits(spark, path)), default=-1) + 1
    at = f"{path}/segments/gen={gen}"
    segments(digested(entries), gen).write.mode("overwrite").parquet(at)
    _commit(spark, path, gen, gen, *_sums(spark.read.schema(_ROW).parquet(at)))
    return read(spark, path)


def update(path: str, changed: DataFrame, gone: DataFrame) -> Index:
    """Add a generation: changed are new or changed entries (whole rows), gone the ids (id) of deleted ones. Only these rows are tokenised."""
    spark = changed.sparkSession
    index, commits = read(spark, path), _commits(spark, path)
    gen, base = commits[-1]["gen"] + 1, commits[-1]["base"]
    fresh = stash(digested(changed))
    touched = fresh.select("id").unionByName(gone.select(F.col("id").cast("long").alias("id"))).distinct()
    replaced = stash(index.alive().join(touched, "id").select(F.lit(gen).cast("long").alias("gen"), "segment", F.col("place").cast("int").alias("place"), "length"))
    lost = replaced.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    replaced.drop("length").write.mode("overwrite").parquet(f"{path}/dead/gen={gen}")
    at = f"{path}/segments/gen={gen}"
    segments(fresh, gen).write.mode("overwrite").parquet(at)
    entries, words, more = _sums(spark.read.schema(_ROW).parquet(at))
    _commit(spark, path, gen, base, entries - int(lost[0]), words - int(lost[1]), more)
    return read(spark, path)


def maintain(entries: DataFrame, path: str) -> Index:
    """The index of entries in a folder: made where there is none, else brought up to date with what differs by digest. Ids must be different."""
    spark = entries.sparkSession
    index = read(spark, path)
    if index is None:
        return build(entries, path)
    now = digested(entries)
    known = index.alive().select("id", F.col("digest").alias("known"))
    both = stash(now.select("id", "digest").join(known, "id", "full_outer").filter("digest IS NULL OR known IS NULL OR digest <> known"))
    changes = both.count()
    if not changes:
        return index
    live = [c for c in _commits(spark, path) if c["base"] == _commits(spark, path)[-1]["base"]]
    dead = index.dead.count() if index.dead is not None else 0
    if len(live) >= MOST_GENERATIONS or dead + changes > index.entries:
        return build(entries, path)
    return update(path, entries.join(both.filter("digest IS NOT NULL").select("id"), "id", "left_semi"), both.filter("digest IS NULL").select("id"))


def built(entries: DataFrame, path: str | None = None) -> Index:
    """An index for one use, in a folder of its own."""
    return build(entries, path or shared_folder(entries.sparkSession))
