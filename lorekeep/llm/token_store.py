"""Token ids in a content-addressed store of Parquet tables.

A rolling hash over the last ids cuts each document's id stream into chunks, so equal passages make equal chunks wherever they
stand. Below the store's path lie

* data/kind=chunk: each unique chunk once, as digest (BLAKE2b, 16 bytes) and payload (little-endian ids),
* data/kind=recipe: what the same pass wrote for each document, its chunks' digests and ends,
* recipes: the recipes in ascending doc_id order with start, the ids of all documents before,
* manifest: a Merkle tree: a node for BLOCK documents, one for each part of the recipes and one for the store.

Texts are encoded once; one shuffle by digest makes chunks unique, each task having dropped those it has already sent, so
a hot chunk costs a row per task. Reading back checks every payload against its digest and every node against the recipes, and
computes a document's CRC-32 from its chunks' CRCs, which combine in any order: no ids are shuffled for it.

Defined results: a null text is empty and has the end id only; null doc_ids come first; rows with equal doc_ids each have their
own place, in an order that depends on their content; an empty table makes an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm._shared import documents, lean, shared_folder, slices
from lorekeep.llm._tokens import default_path, encoder

#: A chunk ends where the hash of its last SPAN ids has MASK's bits 0, with LEAST to MOST ids.
SPAN, MASK, LEAST, MOST = 8, 0xFF, 32, 2048
BLOCK = 1024
#: Digests that a task remembers as sent (about 100 bytes each).
SENT = 150_000
#: Bytes of text whose different words are encoded together.
TOGETHER = 1 << 24

#: Ids that are hashed at once, so that their hashes stay in a core's cache.
HASHED = 1 << 14

_WEIGHTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(SPAN)]
_TABLE = np.random.default_rng(6).integers(0, 1 << 63, 1 << 12, np.uint64) | np.uint64(1)


def cuts_of(ids: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each of the id streams that lie between offsets. As no chunk is shorter than SPAN, the hash never tells of the stream before."""
    marks = [np.zeros(0, np.int64)]
    for lo in range(0, len(ids), HASHED):
        before = min(lo, SPAN - 1)
        part = ids[lo - before : lo + HASHED]
        x = _TABLE[part & 0xFFF] + part
        rolled, y = np.zeros(len(x), np.uint64), np.empty(len(x), np.uint64)
        for k in range(min(SPAN, len(x))):
            rolled[k:] += np.multiply(x[: len(x) - k], _WEIGHTS[k], out=y[k:])
        rolled >>= np.uint64(40)
        rolled &= np.uint64(MASK)
        marks.append(np.flatnonzero(rolled[before:] == 0) + lo + 1)
    marks = np.concatenate(marks)
    at = np.searchsorted(marks, offsets, "right")
    for start, stop, a, b in zip(offsets.tolist(), offsets[1:].tolist(), at, at[1:]):
        found, last, n = [], 0, stop - start
        for end in (marks[a:b] - start).tolist():
            while end - last > MOST:
                last += MOST
                found.append(last)
            if end - last >= LEAST:
                found.append(end)
                last = end
        while n - last > MOST:
            last += MOST
            found.append(last)
        yield found if last == n else [*found, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return next(cuts_of(ids, np.array([0, len(ids)])))


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of two kinds: unique-in-task chunks and recipes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent, task, row = encoder(tokenizer), set(), TaskContext.get().partitionId(), 0

        def rows(doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
            nonlocal row
            for doc_id, start, ends in zip(doc_ids, offsets.tolist(), cuts_of(ids, offsets)):
                digests, last = [], 0
                for cut in ends:
                    payload = ids[start + last : start + cut].tobytes()
                    digests.append(digest(payload))
                    if digests[-1] not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(digests[-1])
                        yield ("chunk", digests[-1], payload, None, None, None)
                    last = cut
                yield ("recipe", struct.pack(">qq", task, row), None, doc_id, digests, ends)
                row += 1

        for batch in batches:
            for lo, hi, _, _ in slices(batch.column("text"), TOGETHER):
                ids, offsets = encode.streams(batch.column("text").slice(lo, hi - lo), end_id)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), ids, offsets)), kinds)], names)

    names = ["kind", "digest", "payload", "doc_id", "digests", "ends"]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run, "encoder"), "kind string, digest binary, payload binary, doc_id long, digests array<binary>, ends array<int>")


def _nodes(recipes: DataFrame) -> DataFrame:
    """The Merkle tree above the recipes: level 0 for blocks of documents, 1 for parts, 2 for the store."""
    order = Window.partitionBy("part").orderBy("start")
    leaf = F.sha2(F.concat_ws("", F.transform("digests", lambda x: F.hex(x))), 256)
    rows = recipes.select("part", "start", leaf.alias("node")).withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))

    def above(nodes: DataFrame, at: str, *by: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "node")))
        return nodes.groupBy(*by).agg(F.sha2(F.concat_ws("", F.transform(listed, lambda x: x.node)), 256).alias("node"))

    blocks = above(rows, "start", "part", "block")
    parts = above(blocks, "block", "part")
    top = above(parts, "part")
    return blocks.select(F.lit(0).alias("level"), "part", "block", "node").unionByName(parts.select(F.lit(1).alias("level"), "part", F.lit(None).cast("long").alias("block"), "node")).unionByName(top.select(F.lit(2).alias("level"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("block"), "node"))


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Write the store of the documents' ids, end_id after each document, to a new path that all executors share."""
    spark = docs.sparkSession
    # the first of equals by a window: one sort behind the shuffle, where dropDuplicates sorts payloads on both sides of it
    same = Window.partitionBy("kind", "digest").orderBy("digest")
    _encoded(docs, tokenizer or default_path(), end_id).withColumn("again", F.lag("kind").over(same)).filter("again IS NULL").drop("again").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    recipes = _data(spark, path).filter("kind = 'recipe'").select("doc_id", "digests", "ends", "digest")
    recipes.repartitionByRange("doc_id", "digest").sortWithinPartitions(F.asc_nulls_first("doc_id"), "digests", "digest").withColumn("part", F.spark_partition_id()).withColumn("n_tokens", F.element_at("ends", -1).cast("long")).write.parquet(f"{path}/sorted")
    ordered = spark.read.schema("doc_id long, digests array<binary>, ends array<int>, digest binary, part int, n_tokens long").parquet(f"{path}/sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "digests", "digest").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    starts.select("part", "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "digests", "ends").write.parquet(f"{path}/recipes")
    _nodes(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, payload binary, doc_id long, digests array<binary>, ends array<int>, kind string").parquet(f"{path}/data")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, start long, n_tokens long, digests array<binary>, ends array<int>").parquet(f"{path}/recipes")


def _places(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document."""
    rows = recipes.select("doc_id", "start", "n_tokens", F.posexplode(F.arrays_zip("digests", "ends")).alias("number", "x"))
    return rows.select("doc_id", "start", "n_tokens", "number", F.col("x.digests").alias("digest"), (F.col("n_tokens") - F.col("x.ends")).alias("after"))


_POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), modulo that of CRC-32, bit-reversed."""
    out, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What bytes with this CRC-32 add to the CRC-32 of a string in which so many bytes come after them; the parts are joined by xor."""
    out, square = crc.astype(np.uint32), np.array([1 << 30], np.uint32)
    power = after.astype(np.int64) * 8
    while power.any():
        odd = (power & 1).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(square, odd.sum()))
        square, power = _times(square, square), power >> 1
    return out


def read_digests(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """From the store's files, one row for each document: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers), n_chunks, verified."""
    wide = np.dtype("<u2") if encoder(tokenizer or default_path()).kind == "H" else np.dtype("<u4")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d == digest(p), zlib.crc32(np.frombuffer(p, wide).astype("<u4").tobytes()), len(p) // wide.itemsize) for d, p in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist())]
            sound, crcs, sizes = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(sound, pa.bool_()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "sound", "crc", "n_ids"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = shifted_crc(batch.column("crc").to_numpy(), batch.column("after").to_numpy() * 4)
            yield batch.drop_columns(["crc", "after"]).append_column("part_crc", pa.array(crc.astype(np.int64)))

    chunks = _data(spark, path).filter("kind = 'chunk'").select("digest", "payload").mapInArrow(lean(checked), "digest binary, sound boolean, crc long, n_ids long")
    rows = _places(_recipes(spark, path)).join(chunks, "digest").select("doc_id", "start", "n_tokens", "sound", "n_ids", "crc", "after")
    rows = rows.mapInArrow(lean(moved), "doc_id long, start long, n_tokens long, sound boolean, n_ids long, part_crc long")
    rows = rows.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("part_crc").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.min("sound").alias("sound"), F.sum("n_ids").alias("n_ids"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", (F.col("sound") & (F.col("n_ids") == F.col("n_tokens"))).alias("verified"))


def read_ids(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """The documents' ids again: doc_id, start, ids."""
    wide = np.dtype("<u2") if encoder(tokenizer or default_path()).kind == "H" else np.dtype("<u4")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([np.frombuffer(p, wide).astype(np.int64) for p in batch.column("payload").to_pylist()], pa.list_(pa.int64()))], ["digest", "ids"])

    chunks = _data(spark, path).filter("kind = 'chunk'").select("digest", "payload").mapInArrow(lean(opened), "digest binary, ids array<long>")
    rows = _places(_recipes(spark, path)).join(chunks, "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("chunks"))
    return rows.select("doc_id", "start", F.flatten(F.transform("chunks", lambda x: x.ids)).alias("ids"))


def sound_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's nodes that the recipes do not bear out, and those of the recipes that it lacks; none in a sound store."""
    written = spark.read.schema("level int, part int, block long, node string").parquet(f"{path}/manifest")
    both = written.withColumn("side", F.lit(1)).unionByName(_nodes(_recipes(spark, path)).withColumn("side", F.lit(-1)))
    return both.groupBy("level", "part", "block", "node").agg(F.sum("side").alias("side")).filter("side <> 0")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(documents(spark, sf_dir, "doc_id", "text"))


def stored_digests(docs: DataFrame) -> DataFrame:
    """Write the documents' store in the shared folder and return what its files say."""
    path = shared_folder(docs.sparkSession)
    write_store(docs, path)
    if sound_manifest(docs.sparkSession, path).limit(1).count():
        raise ValueError(f"the recipes in {path} do not fit their manifest")
    return read_digests(docs.sparkSession, path)
