"""Periodic runs of words, by a harmonic grid with prefix hashes.

A run is a stretch of consecutive words with smallest period q and at least max(24, 3 q) words that no neighbouring word extends
keeping the period. For each period p the grid has a point every b words, where b is so small that a stretch of the least length holds a whole
block from one grid point to the next: about n / b points, n log n for all periods together. Per text and all (period, grid point) pairs at once:

1. Blocks are compared with the blocks p words further by differences of one prefix hash; only pairs with equal blocks go on.
2. Binary search over the same prefix hashes gives how far words stay equal to those p words further, forwards and backwards: a stretch.
3. Words are verified: the stretch's bytes against those p words further. Where a hash has met by chance, equal words are counted directly.
4. Stretches that several points or multiples of the period find are one run with the smallest period (of a stretch of three periods, the
   smallest period divides each other one that the grid meets).

Pairs are searched in portions of at most PAIRS, texts in pieces of about PIECE bytes, so memory is bounded by a text's own size. Rows never
leave their task.

Defined results: a null text has no words; a row without doc_id is taken as it is; repeated rows are answered one by one; of equal exponents the
first start counts, then the smaller period; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm._shared import _powers, documents, lean, slices, span_hashes, word_spans

LEAST, TIMES = 24, 3
#: Pairs of a period and a grid point that are searched at once, and words that are hashed at once.
PAIRS, CHUNK = 1 << 20, 1 << 16


class Words:
    """The words of one text: their hashes, and their bytes one behind the other; order: the places of the words that stand for them."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, order: np.ndarray | None = None):
        self.raw, self.plain = raw, order is None
        self.starts, self.ends, self.hashes = (starts, ends, hashes) if order is None else (starts[order], ends[order], hashes[order])
        self.n = len(self.starts)

    def bytes_of(self, a: int, b: int) -> list[bytes]:
        if self.plain and b > a:
            return self.raw[self.starts[a] : self.ends[b - 1]].split()
        return [self.raw[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]

    def equal(self, a: int, b: int, shift: int) -> bool:
        """Whether words a to b are those that stand shift words further."""
        return all(self.bytes_of(k, min(k + CHUNK, b)) == self.bytes_of(k + shift, min(k + CHUNK, b) + shift) for k in range(a, b, CHUNK))

    def digest(self, keep: np.ndarray | None = None) -> str:
        """Of the words, or those kept, joined by one space."""
        sha, first = hashlib.sha256(), True
        for a in range(0, self.n, CHUNK):
            found = self.bytes_of(a, min(a + CHUNK, self.n))
            if keep is not None:
                found = [x for x, k in zip(found, keep[a : a + CHUNK].tolist()) if k]
            if found:
                sha.update(b"" if first else b" ")
                sha.update(b" ".join(found))
                first = False
        return sha.hexdigest()


def _portions(n: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Period, block length and grid point of all pairs for n words, in portions of at most PAIRS (but whole periods)."""
    p = np.arange(1, n // times + 1, dtype=np.int64)
    length = np.maximum(least, times * p)
    p, length = p[length <= n], length[length <= n]
    block = (length - p + 1) // 2
    count = (n - p) // block  # blocks that end, shifted by p, within the text
    upto = np.cumsum(count)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        own = count[lo:hi]
        of = np.repeat(np.arange(lo, hi), own)
        point = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
        yield p[of], block[of], point * block[of]
        lo = hi


def _direct(words: Words, a: int, b: int, p: int) -> tuple[int, int]:
    """How far words from a on, and words before a, equal those p further, by comparing them one by one."""
    one = lambda k: words.raw[words.starts[k] : words.ends[k]]
    fore = a
    while fore + p < words.n and one(fore) == one(fore + p):
        fore += 1
    back = a
    while back and one(back - 1) == one(back - 1 + p):
        back -= 1
    return back, fore


def runs(words: Words, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in the order of start and period."""
    n = words.n
    if n < least:
        return []
    up, _ = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * up[:n], out=sums[1:])

    def same(at: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (sums[at + length] - sums[at]) * up[p] == sums[at + p + length] - sums[at + p]

    found: dict[tuple[int, int], int] = {}
    for p, block, at in _portions(n, least, times):
        hit = np.flatnonzero(same(at, block, p))
        if not len(hit):
            continue
        p, block, at = p[hit], block[hit], at[hit]
        lo, hi = block.copy(), n - p - at  # forwards: lo words are equal, more than hi cannot be
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            ok = same(at, mid, p)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        back, most = np.zeros_like(at), at.copy()
        while (back < most).any():
            mid = (back + most + 1) >> 1
            ok = same(at - mid, mid, p)
            back, most = np.where(ok, mid, back), np.where(ok, most, mid - 1)
        start, end = at - back, at + lo  # words start to end equal those p further
        stretches = np.unique(np.column_stack([p, start, end])[end + p - start >= np.maximum(least, times * p)], axis=0)  # the smallest period first
        for q, s, e in stretches.tolist():
            if (s, e + q) in found:  # a smaller period has been verified, of which this is a multiple
                continue
            if not words.equal(s, e, q):
                inside = [k for k, b, x in zip(at.tolist(), block.tolist(), p.tolist()) if x == q and s <= k and k + b <= e and words.equal(k, k + b, q)]
                for a, b in {_direct(words, k, 0, q) for k in inside}:
                    if b + q - a >= max(least, times * q):
                        found.setdefault((a, b + q), q)
                continue
            found[s, e + q] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repeated_order(doc_id: int, n: int) -> np.ndarray | None:
    """For a tenth of the documents, the place of the word that stands for each word: from a word on, a stretch repeats itself. None: the words as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    k = np.arange(n)
    return np.where(k < a, k, a + (k - a) % p)


def report(words: Words, least: int = LEAST, times: int = TIMES) -> tuple:
    """n_runs, the run of the greatest exponent, and digests of the runs and of the words that collapsed runs leave."""
    found = runs(words, least, times)
    best: tuple = (None, None, None, None)
    keep = None
    if found:
        all_of = np.array(found, np.int64)
        ratio = all_of[:, 1] / all_of[:, 2]
        near = [found[k] for k in np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12)).tolist()]
        s, length, q = min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
        edge = np.zeros(words.n + 1, np.int64)
        np.add.at(edge, all_of[:, 0] + all_of[:, 2], 1)
        np.add.at(edge, all_of[:, 0] + all_of[:, 1], -1)
        keep = np.cumsum(edge)[:-1] == 0
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    return len(found), *best, hashlib.sha256(listed).hexdigest(), words.digest(keep)


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, planted: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id and the report of each row of docs (doc_id, text); planted: after repeated_order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                raw = data.tobytes()
                starts, ends, of = word_spans(data, offsets)
                hashes = span_hashes(data, starts, ends)
                at = np.searchsorted(of, np.arange(hi - lo + 1))
                rows = []
                for doc_id, a, b in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), at.tolist(), at[1:].tolist()):
                    order = repeated_order(doc_id, b - a) if planted and doc_id is not None else None
                    rows.append(report(Words(raw, starts[a:b], ends[a:b], hashes[a:b], order), least, times))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                names = [x.split()[0] for x in COLUMNS.split(", ")]
                schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), *zip(names, kinds)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir, "doc_id", "text"), planted=True)
