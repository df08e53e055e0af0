"""Suffix-array deduplication of byte strings, by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller doc_id.

1. Every window of LENGTH bytes has an anchor, the least hash of its ANCHOR-byte strings; equal windows have equal anchors. Tasks
   count the texts that have an anchor. Those that two texts have fill a bitmap of a size that the corpus' files set, and those of HOT texts or more another.
   The first only keeps text that surely recurs nowhere from being sent; where it is full it lets all pass. Windows of the second get
   a key of their anchor and of the greatest hash of their strings, so that what surrounds a common passage is spread over many keys.
2. Runs of windows with one key are segments. Tasks send each of their distinct segments once, with the least and the greatest doc_id that
   has it and its bytes, to its key's partition, so a window meets all its equals there.
3. There, a segment that is the only one of its key has all its windows from the first document that has it. Other distinct segments of whole keys are joined into texts of about TEXT bytes. Each gets its suffix order and Burrows-Wheeler
   transform, and intervals of equal prefixes are extended backwards, breadth first: level by level this settles where neighbouring
   suffixes have common prefixes of 0, 1, 2, ... bytes, and stops at LENGTH - 1. Suffixes with no such border between them share LENGTH
   bytes; each such group has a first document, and a segment's windows whose group began before the last document that has it are its runs.
4. The documents are read again. Segments that have runs (told by a third bitmap, of the same kind) are joined with them by key and segment,
   which adaptive execution can split; what a document loses meets its text once, and it is cut.

Memory is bounded by a text of TEXT bytes, or by one key's distinct segments if they are more.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; strings that recur only within one document, or in
rows with the same doc_id, stay; rows with equal doc_ids have a result each; a null doc_id counts as smallest; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import _powers, documents, lean, mixed, run_tables, slices, stash
from lorekeep.sources.tables import version

LENGTH, ANCHOR = 50, 20
#: Least number of upper bits of an anchor that make its bucket, and bytes of text for one bucket: tasks hold one bucket at a time, about 4 million anchors, so a larger corpus has more.
BUCKET, BUCKET_BYTES = 10, 1 << 26
#: Bytes of text in one byte of a file, at most: what the size of a corpus is estimated with.
INFLATED = 8
#: Bits of a bitmap, texts that make an anchor hot, most windows in a segment, bytes of text for one transform, bytes of segments that a task sends at once.
BITMAP, HOT, WINDOWS, TEXT, SENT = 1 << 26, 1000, 256, 1 << 18, 1 << 24
#: Bytes of text (as INFLATED has them) for a bit of the bitmaps, and most bits of one: beyond BITMAP they grow with the corpus, as a full one lets all segments pass.
BIT_BYTES, MOST_BITS = 64, 1 << 29
#: Bytes of text whose anchors are made at once: their arrays stay in a core's cache.
NEAR = 1 << 18
_NONE = -(1 << 63)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, number of windows, anchor and key of each segment of these texts. The key is the anchor, but for those in the bitmap hot."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[anchor:] - sums[:-anchor]) * down[: len(data) - anchor + 1])
    least = _least(hashes, length - anchor + 1)[:n]
    inside = np.zeros(n, bool)
    for a, b in zip(offsets, offsets[1:]):
        inside[a : max(a, b - length + 1)] = True
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    cuts = offsets[:-1][(offsets[:-1] < n)]
    new[cuts] = inside[cuts]
    key = least
    if hot is not None and hot.any():
        begin = np.flatnonzero(new)
        is_hot = np.zeros(len(begin) + 1, bool)
        is_hot[1:] = _held(least[begin], hot)
        is_hot = is_hot[np.cumsum(new)] & inside
        if is_hot.any():
            most = ~_least(~hashes, length - anchor + 1)[:n]
            new[1:] |= is_hot[1:] & (most[1:] != most[:-1])
            key = np.where(is_hot, mixed(least + (most ^ (most >> np.uint64(7)))), least)
    starts = np.flatnonzero(new)
    ends = np.minimum(np.append(starts[1:], n), offsets[np.searchsorted(offsets, starts, "right")] - length + 1)
    pieces = (ends - starts + WINDOWS - 1) // WINDOWS
    owner = np.repeat(np.arange(len(starts)), pieces)
    begin = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOWS
    windows = np.minimum(ends[owner] - begin, WINDOWS)
    return np.searchsorted(offsets, begin, "right") - 1, begin, windows, least[begin], key[begin]


def _names(data: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A hash of each segment's bytes and length."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * up[: len(data)], out=sums[1:])
    return mixed((sums[begin + windows + LENGTH - 1] - sums[begin]) * down[begin] * np.uint64(0xA24BAED4963EE407) + windows.astype(np.uint64))


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 48-bit values as the byte planes of their differences, and the number of texts of each up to 65,535, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    planes = np.minimum(counts, 65535).astype("<u2").view(np.uint8).reshape(-1, 2)
    return zlib.compress(np.ascontiguousarray(steps.T).tobytes() + np.ascontiguousarray(planes.T).tobytes(), 1)


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = raw[: 6 * n].reshape(6, n).T
    return np.cumsum(steps.view("<u8").ravel()), np.ascontiguousarray(raw[6 * n :].reshape(2, n).T).view("<u2").ravel()


def _spread(anchors: np.ndarray) -> np.ndarray:
    """48 bits of each anchor. An anchor is the least of many hashes, so its upper bits are mostly zeros: they are mixed before buckets are made of them."""
    return mixed(anchors) >> np.uint64(16)


def bucket_bits(docs: DataFrame) -> int:
    """Bits of a bucket for a corpus of this size, as its files have it."""
    size = INFLATED * sum(length for _, length, _ in version(docs))
    return min(26, max(BUCKET, (size // BUCKET_BYTES).bit_length()))


def bitmap_bits(docs: DataFrame) -> int:
    """Bits of a bitmap for a corpus of this size, a power of two."""
    size = INFLATED * sum(length for _, length, _ in version(docs))
    return min(MOST_BITS, max(BITMAP, 1 << (size // BIT_BYTES - 1).bit_length()))


def _meeting(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, where its segments meet. Like anchors they are mixed first: as the least of many hashes they have few different upper bits, and many keys would meet in one."""
    return (mixed(keys) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _anchors(batches: Iterator[pa.RecordBatch], bucket: int = BUCKET) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, packed): 48 bits of the anchors by their upper bits, each once in about 4 million, with the number of texts that have it."""
    held: list[np.ndarray] = []

    def met() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        own = (found >> np.uint64(48 - bucket)).astype(np.int64)
        cuts = [*np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist(), len(own)]
        rows = [(int(own[a]), b - a, _packed(found[a:b], counts[a:b])) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "n", "packed"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text"), NEAR):
            of, _, _, anchors, _ = segments(data, offsets)
            anchors = _spread(anchors)
            order = np.lexsort((anchors, of))
            of, anchors = of[order], anchors[order]
            once = np.ones(len(of), bool)
            once[1:] = (of[1:] != of[:-1]) | (anchors[1:] != anchors[:-1])
            held.append(anchors[once])
            if sum(map(len, held)) > 4_000_000:
                yield met()
    if sum(map(len, held)):
        yield met()


def _marks(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a bitmap for each value."""
    spread = mixed(values)
    return spread & np.uint64(bits - 1), (spread >> np.uint64(32)) & np.uint64(bits - 1)


def _mark(bitmap: np.ndarray, values: np.ndarray) -> None:
    for places in _marks(values, len(bitmap) * 8):
        places = np.unique(places).astype(np.int64)
        if len(places):
            first = np.flatnonzero(np.diff(places >> 3, prepend=-1))
            bitmap[places[first] >> 3] |= np.bitwise_or.reduceat(np.left_shift(1, places & 7).astype(np.uint8), first)


def _holds(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether a bitmap has each value, or seems to."""
    found = np.ones(len(values), bool)
    for place in _marks(values, len(bitmap) * 8):
        found &= (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def _held(anchors: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return _holds(_spread(anchors), bitmap)


def _bitmaps(rows: DataFrame, run, *sizes: int) -> list[np.ndarray]:
    """Bitmaps of these numbers of bits that the tasks' run fills: from batches to the bitmaps. Tasks return them in parts, and other tasks join these."""
    width = min(*sizes, 1 << 20) >> 3

    def parts(filled: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, found in filled.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(found.tobytes(), 1)])], ["part", "bits"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(run(batches)).reshape(-1, width)
        yield from parts({part: x for part, x in enumerate(found) if x.any()})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                found[part] = found.get(part, 0) | np.frombuffer(zlib.decompress(packed), np.uint8)
        yield from parts(found)

    out = np.zeros(sum(sizes) >> 3, np.uint8)
    for part, packed in rows.mapInArrow(lean(filled), "part int, bits binary").repartition("part").mapInArrow(lean(joined), "part int, bits binary").collect():
        out.reshape(-1, width)[part] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.split(out, np.cumsum(sizes)[:-1] >> 3)


def _recurring(docs: DataFrame, bits: int, hot: int, bucket: int) -> list[np.ndarray]:
    """Bitmaps of the anchors that several texts have, and of those that at least `hot` texts have: one bucket after another in the tasks."""
    sizes = bits, min(bits, BITMAP)

    def run(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        found = [np.zeros(x >> 3, np.uint8) for x in sizes]
        for table in run_tables(batches, "bucket"):
            both = [_unpacked(p, n) for p, n in zip(table.column("packed").to_pylist(), table.column("n").to_pylist())]
            values, counts = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            values, counts = values[first], np.add.reduceat(counts, first)
            for bitmap, least in zip(found, (2, hot)):
                _mark(bitmap, values[counts >= least])
        return found

    rows = docs.select("text").mapInArrow(lean(lambda x: _anchors(x, bucket)), "bucket int, n int, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    return _bitmaps(rows, run, *sizes)


_SEGMENT = "key int, segment long, least_id long, more long, bytes binary"


def _segments(docs: DataFrame, sent) -> DataFrame:
    """A row for each distinct segment of about SENT bytes of them that may recur: key (32 bits: it only says where to meet), segment (a hash of its bytes), least_id and how much the
    greatest doc_id is more, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring, hot = sent.value
        held: list[tuple] = []

        def distinct() -> pa.RecordBatch:
            keys, names, ids, at = (np.concatenate([x[k] for x in held]) for k in range(4))
            owner = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            order = np.lexsort((ids, names, keys))
            keys, names, ids, at, owner = keys[order], names[order], ids[order], at[order], owner[order]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])))
            last = np.append(first[1:], len(keys)) - 1
            payload = [held[o][4][k] for o, k in zip(owner[first].tolist(), at[first].tolist())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(names[first]), pa.array(ids[first]), pa.array(ids[last] - ids[first]), pa.array(payload, pa.binary())], ["key", "segment", "least_id", "more", "bytes"])

        size = 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            for lo, _, data, offsets in slices(batch.column("text"), NEAR):
                of, begin, windows, anchors, keys = segments(data, offsets, hot=hot)
                use = np.flatnonzero(_held(anchors, recurring))
                if not len(use):
                    continue
                of, begin, windows, keys = of[use], begin[use], windows[use], keys[use]
                names, raw = _names(data, begin, windows), data.tobytes()
                _, first, at = np.unique(names ^ (keys >> np.uint64(1)), return_index=True, return_inverse=True)
                short = _meeting(keys)
                payload = [raw[a:b] for a, b in zip(begin[first].tolist(), (begin + windows + LENGTH - 1)[first].tolist())]
                held.append((short, names.view(np.int64), doc_ids[lo + of], at, payload))
                size += sum(map(len, payload)) + 28 * len(of)
                if size > SENT:
                    yield distinct()
                    size = 0
        if held:
            yield distinct()

    return docs.select("doc_id", "text").mapInArrow(lean(run), _SEGMENT)


def _occurrences(docs: DataFrame, sent) -> DataFrame:
    """A row for each place of a segment that seems to have runs: key, segment, doc_id, place (text_key in the upper half, the first byte in the lower)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring, hot, known = sent.value
        for batch in batches:
            doc_ids, texts = (batch.column(c).to_numpy() for c in ("doc_id", "text_key"))
            for lo, _, data, offsets in slices(batch.column("text"), NEAR):
                of, begin, windows, anchors, keys = segments(data, offsets, hot=hot)
                use = np.flatnonzero(_held(anchors, recurring))
                of, begin, windows, keys = of[use], begin[use], windows[use], keys[use]
                names = _names(data, begin, windows)
                use = np.flatnonzero(_holds(names, known))
                if len(use):
                    rows = lo + of[use]
                    place = (texts[rows].astype(np.int64) << 32) | (begin - offsets[of])[use]
                    yield pa.RecordBatch.from_arrays([pa.array(_meeting(keys[use])), pa.array(names[use].view(np.int64)), pa.array(doc_ids[rows]), pa.array(place)], ["key", "segment", "doc_id", "place"])

    return docs.mapInArrow(lean(run), "key int, segment long, doc_id long, place long")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text of small symbols whose last is its only 0, by prefix doubling: suffixes are sorted by as many symbols as fit a word,
    then those not yet alone with their prefix, again and again, by their rank and that of the suffix behind it."""
    n, bits = len(text), int(text.max()).bit_length()
    done = 63 // bits
    key, padded = np.zeros(n, np.int64), np.concatenate([text.astype(np.int64), np.zeros(done, np.int64)])
    for k in range(done):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while len(places := np.flatnonzero(~(new & np.append(new[1:], True)))):
        part = order[places]
        behind = part + done
        key = rank[part] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        turn = np.argsort(key)
        part, key = part[turn], key[turn]
        order[places] = part
        new[places] = first = np.append(True, key[1:] != key[:-1])
        rank[part] = places[first][np.cumsum(first) - 1]
        done *= 2
    return order


class Transform:
    """The Burrows-Wheeler transform of a text as a wavelet matrix: for intervals of suffixes, those of all extensions by one symbol to the left."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << int(text.max()).bit_length()))]).astype(np.int32)
        self.bits = max(1, int(text.max()).bit_length())
        self.zeros, at = [], np.zeros(1 << self.bits, np.int64)
        symbols, codes = text[order - 1], np.arange(1 << self.bits)
        for bit in range(self.bits - 1, -1, -1):
            one = (symbols >> bit) & 1 == 1
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            at = np.where((codes >> bit) & 1 == 1, zeros[-1] + at - zeros[at], zeros[at])
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.begin = at.astype(np.int32)

        self.symbol = text[order - 1].astype(np.int16)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.before = place[order - 1]

    def extended(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The extension of an interval of one suffix is the suffix that starts a symbol earlier; two suffixes stay together if they have the same symbol before them; larger intervals go
        down the matrix."""
        size = hi - lo
        two = lo[size == 2]
        same = self.symbol[two] == self.symbol[two + 1]
        pair, apart = self.before[two[same]], two[~same]
        single = self.before[np.concatenate([lo[size == 1], apart, apart + 1])]
        lo, hi = lo[size > 2], hi[size > 2]
        code = np.zeros(len(lo), np.int32)
        for zeros in self.zeros:
            zlo, zhi = zeros[lo], zeros[hi]
            left, right = np.flatnonzero(zhi > zlo), np.flatnonzero(hi - lo > zhi - zlo)
            lo, hi, code = (
                np.concatenate([zlo[left], (lo - zlo)[right] + zeros[-1]]),
                np.concatenate([zhi[left], (hi - zhi)[right] + zeros[-1]]),
                np.concatenate([code[left] * 2, code[right] * 2 + 1]),
            )
        size = hi - lo
        lo = self.first[code] + lo - self.begin[code]
        return np.concatenate([single, pair, lo]), np.concatenate([single + 1, pair + 2, lo + size])


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where suffixes next to each other in order have a common prefix shorter than length: border[i] for suffixes i - 1 and i.

    Breadth-first: the intervals of level k hold the suffixes with a common prefix of k symbols. An extension's end that is no
    border yet is one with a common prefix of k, and only such extensions go on.
    """
    transform, border = Transform(text, order), np.zeros(len(text) + 1, bool)
    border[0] = border[-1] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, len(text), np.int32)
    for _ in range(length):
        lo, hi = transform.extended(lo, hi)
        new = ~border[hi]
        # the last interval of a level ends where the text does, and always goes on
        new |= hi == len(text)
        lo, hi = lo[new], hi[new]
        border[hi] = True
        if not len(lo):
            break
    return border


def first_documents(parts: list[bytes], windows: np.ndarray, firsts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each part, in order, the smallest first document of all parts that hold the same length bytes; and where each part's windows begin."""
    used = np.unique(np.frombuffer(b"".join(parts), np.uint8))
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(2, len(used) + 2)
    sizes = np.array([len(p) for p in parts])
    text = np.ones(int(sizes.sum()) + len(parts) + 1, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = inside[-1] = False
    text[inside] = symbol[np.frombuffer(b"".join(parts), np.uint8)]
    text[-1] = 0
    order = suffix_order(text)
    group = np.cumsum(borders(text, order, length)[:-1]) - 1
    begin = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(parts)), windows)
    places = starts[owner] + np.arange(len(owner)) - begin[owner]
    document = np.full(len(text), np.iinfo(np.int64).max)
    document[places] = firsts[owner]
    least = np.minimum.reduceat(document[order], np.flatnonzero(np.diff(group, prepend=-1)))
    found = np.empty(len(text), np.int64)
    found[order] = least[group]
    return found[places], begin


def _runs(sent: DataFrame) -> DataFrame:
    """(key, segment, lo, hi, first_id): for windows lo to hi of a segment the first document that has them, where a later one has the segment."""

    def once(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The batch, sorted by key and segment, with one row for each segment."""
        key, segment, least, more = (batch.column(c).to_numpy() for c in ("key", "segment", "least_id", "more"))
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])))
        if len(first) == len(key):
            return batch
        low = np.minimum.reduceat(least, first)
        high = np.maximum.reduceat(least + more, first)
        part = batch.take(pa.array(first))
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("segment"), pa.array(low), pa.array(high - low), part.column("bytes")], batch.schema.names)

    def alone(key: np.ndarray) -> np.ndarray:
        """Which rows, sorted by key, are the only segment of their key: nothing else can have one of its windows."""
        new = np.append(True, key[1:] != key[:-1])
        return new & np.append(new[1:], True)

    def solved(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = once(pa.Table.from_batches(rows).combine_chunks().to_batches()[0])
        key, segment, least, more = (batch.column(c).to_numpy() for c in ("key", "segment", "least_id", "more"))
        windows = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64) - LENGTH + 1
        single = alone(key)
        whole = np.flatnonzero(single & (more > 0))
        several = np.flatnonzero(~single)
        of, lo, hi, firsts = whole, np.zeros(len(whole), np.int64), windows[whole], least[whole]
        if len(several):
            first, begin = first_documents(batch.column("bytes").take(pa.array(several)).to_pylist(), windows[several], least[several])
            change = np.ones(len(first), bool)
            change[1:] = first[1:] != first[:-1]
            change[begin] = True
            at = np.flatnonzero(change)
            end = np.append(at[1:], len(first))
            owner = np.searchsorted(begin, at, "right") - 1
            use = first[at] < (least + more)[several[owner]]
            at, end, owner = at[use], end[use], owner[use]
            of, lo, hi, firsts = (np.concatenate(x) for x in ((of, several[owner]), (lo, at - begin[owner]), (hi, end - begin[owner]), (firsts, first[at])))
        return pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(segment[of]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(firsts)], ["key", "segment", "lo", "hi", "first_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = once(batch)
            key, lo = batch.column("key").to_numpy(), 0
            lengths = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
            lengths = np.where(alone(key), lengths // 8 + 1, lengths)  # they are no part of the text
            while lo < batch.num_rows:
                total = size + np.cumsum(lengths[lo:])
                cut = lo + int(np.searchsorted(total, TEXT))
                ahead = np.flatnonzero(key[cut:] != key[cut]) if cut < batch.num_rows else ()
                if not len(ahead):
                    held.append(batch.slice(lo))
                    size = total[-1]
                    break
                end = cut + int(ahead[0])
                yield solved([*held, batch.slice(lo, end - lo)])
                held, size, lo = [], 0, end
        if held:
            yield solved(held)

    return sent.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(lean(run), "key int, segment long, lo int, hi int, first_id long")


def removed(docs: DataFrame, bits: int | None = None, hot: int = HOT, bucket: int | None = None) -> DataFrame:
    """From (doc_id long, text_key int, text): (doc_id, text_key, runs) with the byte ranges that each document loses (first byte in the upper half, the byte behind the last in the
    lower), overlapping and in no order."""
    context = docs.sparkSession.sparkContext
    bits = bitmap_bits(docs) if bits is None else bits
    marks = _recurring(docs, bits, hot, bucket_bits(docs) if bucket is None else bucket)
    runs = stash(_runs(_segments(docs, context.broadcast(marks))))

    def run(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        found = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            _mark(found, batch.column("segment").to_numpy().view(np.uint64))
        return [found]

    known = _bitmaps(runs.select("segment"), run, bits)
    places = _occurrences(docs, context.broadcast([*marks, *known]))
    lost = places.join(runs, ["key", "segment"]).filter("first_id < doc_id")
    begin = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    lost = lost.select("doc_id", F.shiftright("place", 32).cast("int").alias("text_key"), (F.shiftleft(begin + F.col("lo"), 32) + begin + F.col("hi") + F.lit(LENGTH - 1)).alias("run"))
    return lost.groupBy("doc_id", "text_key").agg(F.collect_list("run").alias("runs"))


def dedup(docs: DataFrame, **parameters) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.hash("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            runs = batch.column("runs")
            at, both = runs.offsets.to_numpy(), runs.values.to_numpy()
            lows, highs = both >> 32, both & 0xFFFFFFFF
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                lo, hi = lows[at[k] : at[k + 1]], highs[at[k] : at[k + 1]]
                if not len(lo):
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                order = np.argsort(lo)
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.append(True, lo[1:] > hi[:-1])
                lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                keep = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)]))
                out.append((len(text), int((hi - lo).sum()), len(lo), hashlib.sha256(keep).hexdigest(), keep))
            sizes, gone, spans, names, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(names, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = rows.join(removed(rows, **parameters), ["doc_id", "text_key"], "left").select("doc_id", "text", F.coalesce("runs", F.array().cast("array<long>")).alias("runs"))
    found = found.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _NONE, F.col("doc_id")).cast(kind))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir, "doc_id", "text")).drop("kept")
