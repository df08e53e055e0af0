"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is its set of 5-word shingles; two are linked if the sets' Jaccard similarity is at least 0.8.

1. Copies of a text are one member, named by the smallest doc_id; nothing below sees the others. A member's signature is one
   byte of the least value of each of TREES x DEPTH hash functions; DEPTH bytes are its label in each tree.
2. A tree is the trie of its sorted labels: the members that share a prefix are a node. The widest nodes have the longest prefix that members of
   the least similarity share in some tree with probability RECALL; every member goes that far, as a tie to a close copy says nothing of its
   other links. Narrower ones, of prefixes longer by STEP up to full labels, lie inside them and are made of the members of shared wide nodes only. In each node,
   members are compared by their signatures with the node's first member, and ties are kept where the share of equal bytes is not surely
   below the similarity (MARGIN standard deviations). The ties of all lengths go through one component search.
3. Where a widest node still holds several components, its members are compared with each other by signatures, in blocks of PART x PART; the
   nodes inside it are compared with it. What only shares a prefix by chance is never tied, so components stay near what is linked.
4. A component is compared exactly and completely: its members are dealt into parts of about PART, each two parts meet in one row
   group, and there a product of incidence matrices gives all intersections. Groups return one row per member (its number of links
   and its component of links there), never pairs. Links between parts are joined by the same component search.

Rows grow with members, and for a component or an undecided node of more than PART members with members x parts; hot keys occur in joins
that adaptive execution can split, or behind partial aggregates.

Defined results: a text with fewer than five words has one shingle of all its words; a null text or one without words links to
nothing, copies included; rows with equal doc_ids are members of their own unless their texts are equal too; null
doc_ids count as smallest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import dealt_anew, documents, lean, mixed, run_tables, shingles, slices, stash

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, STEP, RECALL = 24, 10, 2, 0.999
#: Standard deviations of a signature's estimate by which it may fall short of the similarity.
MARGIN = 5.0
PART = 256
#: Ends of ties for one file of labels, and ties that a task contracts at a time.
EDGES = 100_000
#: Members in nodes for one file of what the widest nodes hold.
HELD = 1_000_000
_NONE = -(1 << 63)

_SEEDS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def found_at(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two members of this similarity share a prefix of so many values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depths(similarity: float = SIMILARITY, recall: float = RECALL) -> list[int]:
    """Prefix lengths, from the narrowest nodes to the widest; the last finds members of the least similarity with probability recall."""
    last = next((d for d in range(DEPTH, 0, -1) if found_at(similarity, d) >= recall), 1)
    return [*range(DEPTH, last, -STEP), last]


def least_estimate(similarity: float) -> float:
    """The share of equal signature bytes below which members are surely less similar."""
    return similarity - MARGIN * (similarity * (1 - similarity) / (TREES * DEPTH)) ** 0.5


def signatures(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each text a byte of the least value of each hash function; rows of texts without shingles mean nothing."""
    out = np.zeros((n, TREES * DEPTH), np.uint8)
    if not len(hashes):
        return out
    present, first = np.unique(of, return_index=True)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            out[present, k] = (mixed(np.minimum.reduceat((hashes ^ seed) * (seed | np.uint64(1)), first)) >> np.uint64(56)).astype(np.uint8)
    return out


def _members(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, copy_key, signature) of each text with words; copy_key is a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                hashes, of = shingles(data, offsets, words)
                found = signatures(hashes, of, hi - lo)
                some = np.bincount(of, minlength=hi - lo) > 0
                part = batch.slice(lo, hi - lo).select(["doc_id", "copy_key"]).append_column("signature", pa.array(list(map(bytes, found)), pa.binary()))
                yield part.filter(pa.array(some))

    keyed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("copy_key"), "text")
    return keyed.mapInArrow(lean(run), "doc_id long, copy_key string, signature binary")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _tied(pairs: DataFrame, least: float) -> DataFrame:
    """From (a, b, signature, other): (a, b) of those pairs that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                estimate = (_matrix(batch.column("signature")) == _matrix(batch.column("other"))).mean(1)
                yield batch.select(["a", "b"]).filter(pa.array(estimate >= least))

    return pairs.select("a", "b", "signature", "other").mapInArrow(lean(run), "a long, b long")


def _nodes(depth: int) -> Column:
    """For each tree the key of a member's node at this depth and the rest of its label there, which leads on to narrower nodes."""

    def at(tree: Column) -> Column:
        label = lambda lo, n: F.substring(F.col("signature"), tree * DEPTH + 1 + lo, F.lit(n))
        return F.struct(F.xxhash64(tree, F.lit(depth), label(0, depth)).alias("node"), label(depth, DEPTH - depth).alias("rest"))

    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), at)


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, member and other columns) of nodes with several members, and head: the smallest of them."""
    heads = nodes.groupBy("node").agg(F.min("member").alias("head"), F.max("member").alias("high")).filter("head < high").select(F.col("node").alias("shared"), "head")
    return dealt_anew(nodes, "node").join(dealt_anew(heads, "shared"), F.col("node") == F.col("shared")).drop("shared")


def _blocks(rows: DataFrame, least: float) -> DataFrame:
    """From (node, p, q, side, member, signature): ties (a, b) of members with the smallest member of their component in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in run_tables(batches, "node", "p", "q"):
            members, side, found = table.column("member").to_numpy(), table.column("side").to_numpy(), _matrix(table.column("signature"))
            one = np.flatnonzero(side == 0)
            other = np.flatnonzero(side == 1) if (side == 1).any() else one
            links = np.zeros((len(members), len(members)), bool)
            for k in one.tolist():
                links[k, other] = (found[other] == found[k]).mean(1) >= least
            tied = _smallest(members, links | links.T)
            use = tied != members
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array(members[use]), pa.array(tied[use])], ["a", "b"])

    return rows.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q").select("node", "p", "q", "side", "member", "signature").mapInArrow(lean(run), "a long, b long")


def _dealt(rows: DataFrame, group: str, *carried: str) -> DataFrame:
    """From (group, member, size, carried): each group's members in parts of about PART, with every part (its own too) that they meet: (group, p, q, side, member, carried)."""
    rows = rows.withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).withColumn("own", F.pmod(F.xxhash64("member", F.lit(7)), "parts").cast("int"))
    met = rows.select(group, "member", "own", *carried, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("met"))
    return met.select(group, F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), F.when(F.col("own") <= F.col("met"), 0).otherwise(1).alias("side"), "member", *carried)


def _relabelled(labels: DataFrame, ties: DataFrame) -> DataFrame:
    """labels (member, component) of tied members after more ties (a, b); members without a label are their own component."""
    own = lambda end: labels.select(F.col("member").alias(end), F.col("component").alias(f"{end}_component"))
    ends = ties.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    joined = components(ends).select(F.col("member").alias("old"), F.col("component").alias("new"))
    moved = dealt_anew(labels, "component").join(dealt_anew(joined, "old"), F.col("component") == F.col("old"), "left").select("member", F.coalesce("new", "component").alias("component"))
    fresh = dealt_anew(joined, "old").join(dealt_anew(labels, "member"), F.col("old") == F.col("member"), "left_anti").select(F.col("old").alias("member"), F.col("new").alias("component"))
    return stash(moved.unionByName(fresh))


def forest_components(classes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(member, component) of the members (member, signature) that may be linked to others; components hold together all that may be linked."""
    least, (*narrower, widest) = least_estimate(similarity), depths(similarity, recall)
    files = max(classes.sparkSession.sparkContext.defaultParallelism, classes.count() * TREES // HELD)  # each costs its writers and readers memory
    nodes = classes.select("member", F.explode_outer(_nodes(widest)).alias("x")).select("member", "x.node", "x.rest")
    held = stash(_shared(nodes).coalesce(files))
    heads = held.select("member", "head")
    if narrower:
        inside = F.array(*[F.xxhash64("node", F.lit(d), F.substring(F.col("rest"), F.lit(1), F.lit(d - widest))) for d in narrower])
        heads = heads.unionByName(_shared(held.select("member", F.explode_outer(inside).alias("node"))).select("member", "head"))
    pairs = heads.filter("member <> head").groupBy("member").agg(F.collect_set("head").alias("heads")).join(classes, "member")
    pairs = pairs.select(F.col("member").alias("a"), "signature", F.explode("heads").alias("b")).join(classes.select(F.col("member").alias("b"), F.col("signature").alias("other")), "b")
    labels = components(stash(_tied(pairs.coalesce(files), least)))
    # a node whose members are in several components is compared completely
    spots = held.select("node", "member")
    placed = spots.join(labels, "member", "left").select("node", "member", F.coalesce("component", "member").alias("component"))
    open_nodes = placed.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").select(F.col("node").alias("open"), "size")
    rows = dealt_anew(spots, "node").join(dealt_anew(open_nodes, "open"), F.col("node") == F.col("open")).select("node", "member", "size").join(classes.select("member", "signature"), "member")
    return _relabelled(labels, stash(_blocks(_dealt(rows, "node", "signature"), least)))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of ties (a, b), and for each the smallest that these ties lead to."""
    members, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    found = np.arange(len(members))
    while True:
        new, low = found.copy(), np.minimum(found[one], found[other])
        for end in (found[one], found[other], one, other):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == found).all():
            return members, members[found]
        found = new


def _contracted(ties: DataFrame) -> DataFrame:
    """Ties (a, b) that lead as far as the given ones: of each EDGES ties of a task, every member with the smallest that they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            members, roots = _roots(*(np.concatenate(x) for x in zip(*held)))
            use = members != roots
            return pa.RecordBatch.from_arrays([pa.array(members[use]), pa.array(roots[use])], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) >= EDGES:
                yield stars()
                held = []
        if held:
            yield stars()

    return ties.select("a", "b").mapInArrow(lean(run), "a long, b long")


def components(ties: DataFrame) -> DataFrame:
    """(member, component) for all members of ties (a, b): component is the smallest member that ties lead to.

    Ties are contracted in the tasks that read them. Then each round takes the smallest label among neighbours and the label that this
    label had, and writes the labels; the ends of a chain come together in about as many rounds as the logarithm of its length.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    both = stash(_contracted(ties).select(ends).select("x.a", "x.b"))
    files = max(ties.sparkSession.sparkContext.defaultParallelism, both.count() // EDGES)  # of the labels of each round
    labels = stash(both.groupBy(F.col("a").alias("member")).agg(F.least(F.min("a"), F.min("b")).alias("component")).coalesce(files))
    while True:
        near = both.join(labels, F.col("b") == F.col("member")).groupBy("a").agg(F.min("component").alias("near"))
        near = labels.join(near, F.col("a") == F.col("member")).select("member", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("member").alias("label"), F.col("component").alias("further"))
        moved = stash(dealt_anew(near, "component").join(dealt_anew(far, "label"), F.col("component") == F.col("label")).select("member", "old", F.least("component", "further").alias("component")).coalesce(files))
        labels = moved.select("member", "component")
        if not moved.filter("component <> old").limit(1).count():
            return labels


def _smallest(members: np.ndarray, links: np.ndarray) -> np.ndarray:
    """For each row the smallest member of its component in a symmetric matrix of links."""
    label = np.arange(len(members))[np.argsort(members, kind="stable")]
    found = np.empty(len(members), np.int64)
    found[label] = np.arange(len(members))
    while True:
        new = np.minimum(found, np.where(links, found[None, :], len(members)).min(1))
        new = new[label[new]]
        if (new == found).all():
            return members[label[found]]
        found = new


def _set_sizes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([len(x) for x in sets], np.float64)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets left x right, from incidence matrices of so many shingles at a time. Shingles of one set only are left out."""
    unique, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    number = np.cumsum(counts > 1) - 1
    use = counts[place] > 1
    place, owner = number[place[use]], owner[use]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int((counts > 1).sum()), columns):
        a, b = np.searchsorted(place, [lo, lo + columns])
        seen = np.zeros((len(sets), columns), np.float32)
        seen[owner[a:b], place[a:b] - lo] = 1
        out += seen[left] @ seen[right].T
    return out


def _linked(table: pa.Table, words: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group's rows: members, their numbers of links within it and the smallest member of their component of links."""
    members, side = table.column("member").to_numpy(), table.column("side").to_numpy()
    once = np.sort(np.unique(members * 2 + side, return_index=True)[1])  # a row that is in the table twice comes twice
    members, side, table = members[once], side[once], table.take(pa.array(once))
    sets = []
    for chunk in table.column("text").chunks:
        for lo, hi, data, offsets in slices(chunk):
            hashes, of = shingles(data, offsets, words)
            at = np.searchsorted(of, np.arange(hi - lo + 1))
            sets += [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]
    one = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if (side == 1).any() else one
    sizes = _set_sizes(sets)
    common = intersections(sets, one, other)
    near = common >= similarity * (sizes[one][:, None] + sizes[other][None, :] - common) - 1e-9
    links = np.zeros((len(sets), len(sets)), bool)
    links[np.ix_(one, other)] = near
    if one is other:
        np.fill_diagonal(links, False)
    links |= links.T
    return members, links.sum(1), _smallest(members, links)


def _verified(parts: DataFrame, words: int, similarity: float) -> DataFrame:
    """For each row group (component, p, q) the rows (member, component, n_links, tied_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for table in run_tables(batches, "component", "p", "q"):
            members, links, tied = _linked(table, words, similarity)
            held.append((members, links, tied))
            if sum(len(x[0]) for x in held) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["member", "n_links", "tied_to"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["member", "n_links", "tied_to"])

    return parts.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").select("component", "p", "q", "side", "member", "text").mapInArrow(lean(run), "member long, n_links long, tied_to long")


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest doc_id that links and copies lead to), text_id (smallest doc_id with the same text), n_links (other texts that it is linked to) and n_copies."""
    kind = dict(docs.dtypes)["doc_id"]
    numbered = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    members = stash(_members(docs.select(numbered.alias("doc_id"), "text"), words))
    classes = members.groupBy("copy_key").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.first("signature").alias("signature"))
    classes = stash(classes.withColumn("member", F.monotonically_increasing_id()))
    members = members.select("doc_id", "copy_key")
    found = forest_components(classes.select("member", "signature"), similarity, recall)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).withColumnRenamed("component", "whole")
    placed = found.join(dealt_anew(sizes, "whole"), F.col("component") == F.col("whole")).join(classes.select("member", "copy_key", "text_id"), "member").select("member", "component", "size", "copy_key", "text_id")
    source = docs.select(numbered.alias("text_id"), F.md5(F.col("text").cast("binary")).alias("copy_key"), "text")
    met = _dealt(placed.join(source, ["text_id", "copy_key"]), "component", "text")
    linked = stash(_verified(met, words, similarity))
    counted = linked.groupBy("member").agg(F.sum("n_links").alias("n_links")).filter("n_links > 0")
    joined = components(linked.select(F.col("member").alias("a"), F.col("tied_to").alias("b")))
    named = classes.select("member", "copy_key", "text_id", "n_copies").join(joined, "member", "left").withColumn("component", F.coalesce("component", "member"))
    names = named.groupBy(F.col("component").alias("whole")).agg(F.min("text_id").alias("class_id"))
    named = named.join(dealt_anew(names, "whole"), F.col("component") == F.col("whole")).join(counted, "member", "left").select("copy_key", "class_id", "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    rows = members.select("doc_id", "copy_key").join(stash(named), "copy_key").select("doc_id", "class_id", "text_id", "n_links", "n_copies")
    alone = docs.filter("text IS NULL OR NOT text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select(numbered.alias("doc_id"))
    rows = rows.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
    given = lambda c: F.when(F.col(c) != _NONE, F.col(c)).cast(kind).alias(c)
    return rows.select(given("doc_id"), given("class_id"), given("text_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with, of each class, only the one that names it. Of rows with that doc_id and different texts all stay, of equal ones one; rows without doc_id stay."""
    kept = join(docs, **parameters).filter("doc_id = class_id").select("doc_id").distinct()
    digest = F.md5(F.col("text").cast("binary"))  # what is shuffled to find equal rows: never the text for its own sake
    rows = docs.join(kept, "doc_id").withColumn("_lk_digest", digest).dropDuplicates(["doc_id", "_lk_digest"]).select(*docs.columns)
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir, "doc_id", "text"))
