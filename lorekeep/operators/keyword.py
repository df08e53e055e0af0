"""Keyword search: a weighted BM25 over the segments of a keyword index, exact to the k best.

1. The asked terms are cut from the index's lists. A phrase's list is made from its tokens' spots: those of the n-th token, moved back by n, that all tokens have in common.
2. Document frequencies are the whole bank's and come from that cut; with them each term of a query has a factor.
3. Segments are dealt into stripes; a stripe's lists and all queries meet in one task. There a query's terms are taken by falling upper bound (factor times the best
   value of the term in the stripe). Once what is left cannot lift an entry without any of the terms so far to the k-th score, only entries that still can
   are looked up in the remaining lists, and blocks of a list (BLOCK neighbouring entries) in which there are none are skipped.
4. A task returns at most k rows for a query and context, which are ranked. Sums are compared after rounding to 9 digits, and pruned with a margin above that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens  # noqa: F401  search texts are cut like entries
from lorekeep.operators.index import COLUMNS, SHIFT, Index, dealt
from lorekeep.sources.tables import stash

WEIGHTS = {"value": 1.0, "source_file": 8.0, "section": 16.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Columns that texts, paths, and paths with a section are looked for in.
SEARCHED = (WEIGHTS, {"source_file": WEIGHTS["source_file"]}, {c: WEIGHTS[c] for c in ("source_file", "section")})
#: Different terms up to which they are sent to every task.
BROADCAST_TERMS = 200_000
#: Segments of a stripe, and neighbouring entries whose part of a list is a block.
STRIPE, BLOCK = 16, 64
_MARGIN = 1e-6
_COUNTS = tuple(f"f_{c}" for c in COLUMNS)


def _phrases(terms: DataFrame, index: Index) -> DataFrame:
    """(segment, term, places, f_*) of the terms of several tokens, by intersecting the spots of their tokens."""
    parts = terms.select("term", F.posexplode(F.split("term", " ")).alias("shift", "token")).withColumn("wanted", F.size(F.split("term", " ")))
    found = index.lists().select("segment", F.col("term").alias("token"), "spots").join(parts, "token").select("segment", "term", "wanted", "shift", "spots")
    kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4]
    schema = pa.schema(list(zip(["segment", "term", "places", *_COUNTS], kinds)))

    def row(segment: int, term: str, spots: list[np.ndarray]) -> list:
        both = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(spots, key=len))
        place, column = (both >> SHIFT) // len(COLUMNS), (both >> SHIFT) % len(COLUMNS)
        places = np.unique(place)
        return [segment, term, places.tolist(), *(np.bincount(np.searchsorted(places, place[column == c]), minlength=len(places)).tolist() for c in range(len(COLUMNS)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spots, wanted, rows = None, [], 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("segment", "term", "wanted", "shift")]
            lists = batch.column("spots")
            for k, (segment, term, n, shift) in enumerate(zip(*columns)):
                if (segment, term) != key:
                    if key and len(spots) == wanted:
                        rows.append(row(*key, spots))
                    key, spots, wanted = (segment, term), [], n
                spots.append(lists[k].values.to_numpy() - shift)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], schema=schema)
                rows = []
        if key and len(spots) == wanted:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(*key, spots), kinds)], schema=schema)

    sorted_lists = found.repartition("segment", "term").sortWithinPartitions("segment", "term", "shift")
    return sorted_lists.mapInArrow(run, "segment long, term string, places array<int>, f_value array<int>, f_source_file array<int>, f_section array<int>").filter("size(places) > 0")


def _without_dead(lists: DataFrame, index: Index) -> DataFrame:
    """lists without the places of replaced entries."""
    if index.dead is None:
        return lists
    dead = index.dead.groupBy("segment").agg(F.collect_set("place").alias("dead"))  # of one segment
    rows = lists.join(dead, "segment", "left")
    zipped = F.filter(F.arrays_zip("places", *_COUNTS), lambda x: ~F.array_contains(F.coalesce("dead", F.array().cast("array<int>")), x["places"]))
    rows = rows.withColumn("x", F.when(F.col("dead").isNull(), F.arrays_zip("places", *_COUNTS)).otherwise(zipped)).filter("size(x) > 0")
    return rows.select("segment", "term", *(F.col(f"x.{c}").alias(c) for c in ("places", *_COUNTS)))


def asked_lists(asked: DataFrame, index: Index) -> DataFrame:
    """The lists (segment, term, places, f_*) of all different terms of asked (terms), of tokens and of phrases, as a table."""
    known = asked.agg(F.sum(F.size("terms")), F.max(F.exists("terms", lambda t: F.contains(t, F.lit(" "))))).first()
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    single = terms.filter("NOT contains(term, ' ')")
    single = index.lists().select("segment", "term", "places", *_COUNTS).join(F.broadcast(single) if (known[0] or 0) <= BROADCAST_TERMS else single, "term").select("segment", "term", "places", *_COUNTS)
    return stash(_without_dead(single.unionByName(_phrases(terms.filter("contains(term, ' ')"), index)) if known[1] else single, index))


def _held(weights: dict[str, float]) -> Column:
    """How many entries of a list have its term in some of these columns."""
    if set(weights) == set(COLUMNS):
        return F.size("places")
    return F.size(F.filter(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), (F.col(f"f_{c}") for c in weights)), lambda x: x > 0))


class _Stripe:
    """A stripe's entries and lists."""

    def __init__(self, headers: list[dict], lists: list[dict], contexts: list[str] | None, weights: list[dict[str, float]], mean: float, counted: bool):
        self.base, self.ids, self.counted, n = {}, [], counted, 0
        self.mean, self.weights = mean, [np.array([w.get(c, 0.0) for c in COLUMNS]) for w in weights]
        groups, lengths = [], []
        number = {c: k for k, c in enumerate(contexts or [])}
        for h in headers:
            self.base[h["segment"]] = n
            self.ids.append(h["ids"])
            lengths.append(h["lengths"])
            groups.append(np.zeros(len(h["ids"]), np.int64) if contexts is None else np.array([number.get(c, -1) for c in h["ctxs"]], np.int64))
            n += len(h["ids"])
        self.ids, self.group, self.norm = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, groups, lengths))
        self.norm = K1 * (1 - B + B * self.norm / mean)
        self.inside = self.group >= 0
        self.n, self.by_term, self.ready, self.blocks_read, self.blocks_met = n, {}, {}, 0, 0
        for x in lists:
            self.by_term.setdefault(x["term"], []).append(x)

    def term(self, name: str, searched: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Places, values without factor, and the largest value of a term in the columns of a search."""
        if (name, searched) not in self.ready:
            at, value = np.zeros(0, np.int64), np.zeros(0)
            if found := self.by_term.get(name):
                at = np.concatenate([x["places"].astype(np.int64) + self.base[x["segment"]] for x in found])
                f = np.concatenate([np.column_stack(x["counts"]) for x in found]) @ self.weights[searched]
                use = (f > 0) & self.inside[at]
                order = np.argsort(at[use], kind="stable")
                at, f = at[use][order], f[use][order]
                value = f / (f + self.norm[at])
            self.ready[name, searched] = (at, value, float(value.max(initial=0)))
        return self.ready[name, searched]

    def _looked_up(self, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted entries (sorted) are in a list, and where there. Blocks without a wanted entry are not looked at."""
        if self.counted:
            self._count(at, wanted)
        place = np.searchsorted(at, wanted)
        hit = np.flatnonzero(place < len(at))
        hit = hit[at[place[hit]] == wanted[hit]]
        return hit, place[hit]

    def _count(self, at: np.ndarray, wanted: np.ndarray | None) -> None:
        own = np.unique(at // BLOCK)
        self.blocks_met += len(own)
        self.blocks_read += len(own) if wanted is None else int(np.isin(own, wanted // BLOCK).sum())

    def all_of(self, terms: list[str], factors: list[float], searched: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries that hold all of the terms, and their scores."""
        lists = sorted(((*self.term(t, searched)[:2], f) for t, f in zip(terms, factors)), key=lambda x: len(x[0]))
        at, value, factor = lists[0]
        if self.counted:
            self._count(at, None)
        score = value * factor
        for other, value, factor in lists[1:]:
            hit, place = self._looked_up(other, at)
            at, score = at[hit], score[hit] + value[place] * factor
        return at, score

    def any_of(self, terms: list[str], factors: list[float], searched: int, k: int | None, use: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Entries that hold some of the terms, and their scores; with k surely the k best of each context. use: the contexts in question."""
        lists = sorted(((f * self.term(t, searched)[2], f, *self.term(t, searched)[:2]) for t, f in zip(terms, factors)), key=lambda x: -x[0])
        lists = [x for x in lists if len(x[2])]
        left = np.cumsum([0.0, *(x[0] for x in lists[::-1])])[::-1]  # what the terms from here on can add
        score, wanted, tried = np.zeros(self.n), None, np.inf
        fits = self.inside if use is None else np.isin(self.group, use)
        for n, (_, factor, at, value) in enumerate(lists):
            if wanted is None:
                if self.counted:
                    self._count(at, None)
                score[at] += value * factor
            else:
                hit, place = self._looked_up(at, wanted)
                score[wanted[hit]] += value[place] * factor
            rest = left[n + 1]
            if k is not None and n + 1 < len(lists) and rest < 0.7 * tried and rest < score.max(initial=0):
                tried = rest
                among = np.flatnonzero(fits & (score > 0)) if wanted is None else wanted
                least = self._kth(score, among, k)
                if wanted is not None or (least[np.unique(self.group[fits])] > rest + _MARGIN).all():  # entries without any of the terms so far are out
                    wanted = among[score[among] + rest >= least[self.group[among]] - _MARGIN]
        found = np.flatnonzero((score > 0) & fits) if wanted is None else wanted
        return found, score[found]

    def _kth(self, score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
        """For each context the k-th of these scores so far; minus infinity where there are fewer."""
        out = np.full(int(self.group.max(initial=0)) + 1, -np.inf)
        for g in np.unique(self.group[among]).tolist():
            own = score[among[self.group[among] == g]]
            if len(own) >= k:
                out[g] = np.partition(own, len(own) - k)[len(own) - k]
        return out

    def best(self, at: np.ndarray, score: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each context, the smaller id first among equals."""
        if k is None:
            return at, score
        order = np.lexsort((self.ids[at], -np.round(score, 9), self.group[at]))
        at, score = at[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(self.group[at], self.group[at])
        return at[place < k], score[place < k]


def _arrays(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in column]


def search(asked: DataFrame, index: Index, k: int | None = None, weights: tuple[dict[str, float], ...] | None = None, contexts: list[str] | None = None, counted: bool = False) -> DataFrame:
    """The hits (query_id, ctx, id, score) of asked (query_id, searched, every, terms, only): the k best of each query and context, or all.

    searched: the number of its weights; every: whether all terms must be held, else some; a term that is given twice counts twice; only: contexts in which to search, of
    `contexts`; null: in all of them. Without contexts ctx is null and the whole bank one list. counted adds n_hits, how many entries of the context a task has found (exact for `every`), in
    rows without id, and blocks_met and blocks_read in rows without ctx.
    """
    weights = weights or (WEIGHTS,)
    kind, spark = dict(asked.dtypes)["query_id"], asked.sparkSession
    asked = asked.withColumn("number", F.monotonically_increasing_id())
    asked = stash(asked)
    terms = asked.select("number", "searched", F.explode("terms").alias("term")).groupBy("number", "searched", "term").agg(F.count("*").alias("times"))
    lists = asked_lists(asked, index)
    held = reduce(DataFrame.unionByName, (lists.groupBy("term").agg(F.sum(_held(w)).alias("df")).withColumn("searched", F.lit(n)) for n, w in enumerate(weights)))
    idf = F.log((F.lit(index.entries) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    factor = F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("times") * (K1 + 1)
    given = terms.join(held.filter("df > 0"), ["term", "searched"], "left").groupBy("number").agg(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("term", factor.alias("factor")))).alias("known"), F.count("*").alias("wanted"))
    queries = asked.select("number", "query_id", "searched", "every", "only").join(given, "number").filter("size(known) > 0 AND (NOT every OR size(known) = wanted)")

    segments = index.headers().select("segment", "ids", "ctxs", "lengths")
    stripes = max(spark.sparkContext.defaultParallelism, -(-index.segments // STRIPE))
    stripe = dealt(stripes).alias("stripe")
    kinds = {"segment": "long", "ids": "array<long>", "ctxs": "array<string>", "lengths": "array<int>", "term": "string", "places": "array<int>", **dict.fromkeys(_COUNTS, "array<int>"), "query_id": kind, "searched": "int", "every": "boolean", "only": "array<string>", "terms": "array<string>", "factors": "array<double>"}

    def side(df: DataFrame, kind_no: int, stripe: Column) -> DataFrame:
        return df.select(stripe, F.lit(kind_no).alias("kind"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    queries = queries.withColumns({"terms": F.col("known.term"), "factors": F.col("known.factor")})
    rows = side(segments, 0, stripe).unionByName(side(lists, 1, stripe)).unionByName(side(queries, 2, F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")))
    mean, names = index.mean, ["query_id", "ctx", "id", "score", "n_hits", "blocks_met", "blocks_read"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, headers, postings, data = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            stripe, kind_of = batch.column("stripe").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((stripe[1:] != stripe[:-1]) | (kind_of[1:] != kind_of[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if stripe[lo] != now:
                    now, headers, postings, data = stripe[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                if kind_of[lo] == 0:
                    headers += [{"segment": s, "ids": i, "ctxs": c, "lengths": n} for s, i, c, n in zip(part.column("segment").to_pylist(), _arrays(part.column("ids")), part.column("ctxs").to_pylist(), _arrays(part.column("lengths")))]
                    continue
                if kind_of[lo] == 1:
                    postings += [{"segment": s, "term": t, "places": p, "counts": f} for s, t, p, *f in zip(part.column("segment").to_pylist(), part.column("term").to_pylist(), *(_arrays(part.column(c)) for c in ("places", *_COUNTS)))]
                    continue
                data = data or _Stripe(headers, postings, contexts, list(weights), mean, counted)
                if not data.n:
                    continue
                for query, searched, every, only, terms, factors in zip(*(part.column(c).to_pylist() for c in ("query_id", "searched", "every", "only", "terms", "factors"))):
                    use = None if only is None or contexts is None else np.array([n for n, c in enumerate(contexts) if c in only])
                    before = data.blocks_met, data.blocks_read
                    at, score = data.all_of(terms, factors, searched) if every else data.any_of(terms, factors, searched, k, use)
                    if every and use is not None:
                        inside = np.isin(data.group[at], use)
                        at, score = at[inside], score[inside]
                    if counted:
                        groups, n = np.unique(data.group[at], return_counts=True)
                        out += [(query, contexts[g] if contexts else None, None, None, m, None, None) for g, m in zip(groups.tolist(), n.tolist())]
                        out.append((query, None, None, None, None, data.blocks_met - before[0], data.blocks_read - before[1]))
                    at, score = data.best(at, score, k)
                    out += [(query, contexts[g] if contexts else None, i, s, None, None, None) for g, i, s in zip(data.group[at].tolist(), data.ids[at].tolist(), score.tolist())]
            if out:
                types = [batch.schema.field("query_id").type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    # a task for each stripe, however few bytes it has: its work is the scoring
    found = rows.repartitionById(stripes, "stripe").sortWithinPartitions("stripe", "kind").mapInArrow(run, f"query_id {kind}, ctx string, id long, score double, n_hits long, blocks_met long, blocks_read long")
    return found if counted else found.filter("id IS NOT NULL").select("query_id", "ctx", "id", "score")


def ranked(rows: DataFrame, limit: int, *by: str, score: str = "score", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """The limit best rows of each group, with their rank; the columns tie settle equals."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _asked(queries: DataFrame, every: bool) -> DataFrame:
    return queries.select("query_id", F.lit(0).alias("searched"), F.lit(every).alias("every"), "terms", F.lit(None).cast("array<string>").alias("only"))


def any_of(queries: DataFrame, index: Index, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """Entries (query_id, id, score) with some of the terms, the k best or all; queries: (query_id, terms)."""
    return search(_asked(queries, False), index, k, (weights or WEIGHTS,)).select("query_id", "id", "score")


def all_of(queries: DataFrame, index: Index, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """Entries with all of the terms."""
    return search(_asked(queries, True), index, k, (weights or WEIGHTS,)).select("query_id", "id", "score")


def planned(plans: DataFrame, index: Index, limit: int, contexts: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Hits (query_id, ctx, id, score, fell_back) of plans (query_id, is_path, has_section, every, some, fallback, n_content), the k best of each query and context or all.

    A hit has all of `every`, or some of `some` where there is no every. Where at most max(n_content, limit) entries have all of it and there is a fallback, entries with
    some of that replace them: in each context apart. What falls back is found by counting first, so that only that is searched for some terms.
    """
    plans = stash(plans.withColumn("searched", F.when(F.col("has_section"), 2).when(F.col("is_path"), 1).otherwise(0)))
    none = F.lit(None).cast("array<string>")
    strict = stash(search(plans.filter("size(every) > 0").select("query_id", "searched", F.lit(True).alias("every"), F.array_distinct("every").alias("terms"), none.alias("only")), index, k, SEARCHED, contexts, counted=True))
    spots = plans.filter("size(every) > 0 AND size(fallback) > 0").select("query_id", "searched", "n_content", F.col("fallback").alias("terms"), F.explode(F.array(*map(F.lit, contexts)) if contexts else F.array(F.lit(None).cast("string"))).alias("ctx"))
    counts = strict.filter("n_hits IS NOT NULL").groupBy("query_id", "ctx").agg(F.sum("n_hits").alias("n_hits"))
    same = (F.col("s.query_id") == F.col("c.query_id")) & F.col("s.ctx").eqNullSafe(F.col("c.ctx"))
    falls = stash(spots.alias("s").join(counts.alias("c"), same, "left").filter(F.coalesce("n_hits", F.lit(0)) <= F.greatest("n_content", F.lit(limit))).select("s.*"))
    fallen = falls.groupBy("query_id", "searched", "terms").agg(F.collect_list("ctx").alias("only"))  # of the contexts asked for
    loose = plans.filter("size(every) = 0 AND size(some) > 0").select("query_id", "searched", F.col("some").alias("terms"), none.alias("only")).withColumn("fell_back", F.lit(False))
    asked = loose.unionByName(fallen.select("query_id", "searched", "terms", (F.col("only") if contexts else none).alias("only")).withColumn("fell_back", F.lit(True)))
    hits = search(asked.select("query_id", "searched", F.lit(False).alias("every"), "terms", "only"), index, k, SEARCHED, contexts).join(asked.select("query_id", "fell_back"), "query_id")
    gone = falls.select(F.col("query_id").alias("q"), F.col("ctx").alias("c"))
    kept = strict.filter("id IS NOT NULL").join(gone, (F.col("query_id") == F.col("q")) & F.col("ctx").eqNullSafe(F.col("c")), "left_anti")
    return kept.select("query_id", "ctx", "id", "score", F.lit(False).alias("fell_back")).unionByName(hits.select("query_id", "ctx", "id", "score", "fell_back"))
