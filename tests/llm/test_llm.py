"""Operators of lorekeep.llm against brute force, SQL and planted cases, on small tables with nulls, ties and odd texts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import _shared, _stats, _tokens, decontaminate, jaccard_join, language_id, licenses, mixing, quadratic, quality_rules, suffix_dedup, token_counts, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4] + " tail", texts[5].replace("a", "A", 1), texts[6] + "\n" + texts[7], None, "", "   ", "\n\n", "é" * 120, "x" * 5000, "ab" * 400, "🙂 text 🙂" * 20, texts[8] + "  double  spaces ", "one two", "one two"]
    return [(n, t, [None, "en", "de"][n % 3], [None, "s1", "s2", "s1"][n % 4], None if t is None else len(t), 7, "x") for n, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[2], (None, "a row without a number", "en", "s1", 3, 1, "y")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def test_borders():
    rng = np.random.default_rng(1)
    for n, s in ((1, 2), (40, 2), (120, 3), (90, 30)):
        text = np.append(rng.integers(1, s + 1, n), 0).astype(np.int64)
        order = suffix_dedup.suffix_order(text)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        for length in (1, 2, 7):
            common = [next((k for k in range(n + 1) if a + k > n or b + k > n or text[a + k] != text[b + k]), n) for a, b in zip(order, order[1:])]
            assert suffix_dedup.borders(text, order, length)[1:-1].tolist() == [c < length for c in common]


def test_suffix_dedup(docs, plain, empty):
    first = {}
    for doc, text in plain:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], math.inf), -1 if doc is None else doc)
    want = []
    for doc, text in plain:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (-1 if doc is None else doc):
                gone[i : i + 50] = b"\1" * 50
        want.append((doc, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    for parameters in ({}, {"hot": 2}):  # with the second, every anchor that recurs gets its finer key
        got = [tuple(r)[:5] for r in suffix_dedup.dedup(docs, **parameters).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and any(w[2] for w in want)
    assert suffix_dedup.dedup(empty).count() == 0


def test_a_full_bitmap_changes_nothing(docs):
    rows = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.hash("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    wide, narrow = ({(r.doc_id, r.text_key): sorted(r.runs) for r in suffix_dedup.removed(rows, bits=bits).collect()} for bits in (1 << 22, 64))
    assert wide == narrow and wide
    many = {(r.doc_id, r.text_key): sorted(r.runs) for r in suffix_dedup.removed(rows, bucket=19).collect()}
    assert many == wide and suffix_dedup.bucket_bits(rows) == suffix_dedup.BUCKET
    assert suffix_dedup._holds(np.arange(99, dtype=np.uint64), np.full(8, 255, np.uint8)).all()


# 2


def test_base_statistics(plain):
    for _, text in plain:
        got = next(_stats.rows(pa.array([text], pa.string())))
        w = words(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        counts = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert got[:5] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_binomial_bound():
    for k, n, p in ((0, 10, 0.3), (3, 20, 0.4), (5, 400, 0.05)):
        assert quality_rules.binomial_at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality_rules.is_safe(0, 1000, 0.01, 0.001) and not quality_rules.is_safe(0, 100, 0.01, 0.001) and not quality_rules.is_safe(20, 1000, 0.01, 0.5)


def test_quality_rules(spark, docs, empty):
    rng = random.Random(2)
    good = [(n, prose(rng, 60), "en") for n in range(1500)]
    bad = [(n, " ".join(w + "###" for w in prose(rng, 60).split()), "en") for n in range(1500, 1700)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, int(n < 1500)) for n in range(1700)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.rule_verdicts(df, labels, risk=0.05).collect()}
    assert all(got[n] for n in range(1500)) and not any(got[n] for n in range(1500, 1700))
    few = quality_rules.rule_verdicts(docs, labels.limit(0)).collect()
    assert len(few) == docs.count() and all(r.kept != r.base_failed for r in few)
    assert quality_rules.keep(docs, labels.limit(0)).columns == docs.columns
    assert quality_rules.rule_verdicts(empty, labels).count() == 0


def test_quality_rules_with_few_labels(spark):
    rng = random.Random(3)
    rows = [(n, prose(rng, 60) if n % 300 < 240 else " ".join(w + "###" for w in prose(rng, 60).split()), ["de", "fr", "xx"][n // 300]) for n in range(900)]
    rows += [(n, " ".join(w + "###" for w in prose(rng, 60).split()), "es") for n in range(900, 920)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, int(n % 300 < 240 and n < 900)) for n in range(920)], "doc_id long, quality int")
    got = quality_rules.rule_verdicts(df, labels).collect()
    assert all(r.kept == (r.doc_id % 300 < 240) and r.calibrated for r in got if r.doc_id < 900)
    assert all(r.kept and not r.calibrated for r in got if r.doc_id >= 900)
    few = quality_rules.rule_verdicts(df, labels.filter("doc_id % 300 >= 13")).collect()
    assert quality_rules.least_labels(0.02, 0.01) == 228 and not any(r.calibrated for r in few) and all(r.kept for r in few)


def test_cutoffs_against_a_direct_search(spark):
    """Cutoffs of strata with labels of their own for guides, and of one that takes the others' as guides, recounted row by row; and what they do to good documents that were not used."""
    rng = random.Random(21)

    def text(good):
        w = prose(rng, rng.randint(20, 60)).split()
        share = rng.choice([0, 0, 0, 0.02, 0.1]) if good else rng.choice([0.02, 0.3, 0.6, 0.9])
        return " ".join(x + "###" if rng.random() < share else x.upper() if rng.random() < share / 2 else x for x in w)

    rows = [(n, text(n % 5 > 0), "en" if n // 5 % 10 else "de", int(n % 5 > 0)) for n in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    used = df.filter("doc_id < 5000")
    stats = _stats.text_stats(df, "doc_id", "lang", "quality").withColumn("fifth", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0)
    frame = stats.select("doc_id", "lang", "quality", "fifth", *(F.expr(x).alias(r) for r, x in quality_rules.RULES.items())).toPandas()
    cutoffs, calibrated = quality_rules.calibrate(_stats.text_stats(used, "doc_id", "lang"), used.select("doc_id", "quality"), quality_rules.stratum_of())
    assert calibrated == {"en", "de"}
    seen, grid, size = frame[frame.doc_id < 5000], quality_rules.GRID, len(quality_rules.GRID)
    want = {}
    for name in calibrated:
        mine = seen[seen.lang == name]
        good, bad = mine[mine.quality == 1], mine[mine.quality == 0]
        own = len(good) >= quality_rules.OWN * quality_rules.least_labels(quality_rules.RISK, 0.01)
        guides = good[good.fifth] if own else seen[(seen.quality == 1) & (seen.lang != name)]
        tested = good[~good.fifth] if own else good
        assert own == (name == "en")
        share = lambda part, rule, k: (part[rule] > grid[k]).sum() / len(part)
        starts = {}
        for rule in quality_rules.RULES:
            gains = [share(bad, rule, k) - quality_rules.PRICE * share(guides, rule, k) for k in range(size)]
            starts[rule] = size + (max(range(size), key=lambda k: (gains[k], k)) if max(gains) > 0 else size)
        last = None
        for step in range(2 * size + 1):
            rejected = np.zeros(len(tested), bool)
            for rule, start in starts.items():
                if start - step < size:
                    rejected |= (tested[rule] > grid[max(0, start - step)]).to_numpy()
            if not quality_rules.is_safe(int(rejected.sum()), len(tested), quality_rules.RISK, 0.01):
                break
            last = step
        for rule, start in starts.items():
            gains = [(share(bad, rule, k) - quality_rules.PRICE * share(good, rule, k), grid[k]) for k in range(max(0, start - last), size)]
            if gains and max(gains)[0] > 0:
                want[name, rule] = max(gains)[1]
    assert cutoffs == want and len(cutoffs) >= 2
    fresh = frame[(frame.doc_id >= 5000) & (frame.quality == 1)]
    lost = sum(any(row[rule] > cut for (name, rule), cut in cutoffs.items() if name == row["lang"]) for _, row in fresh.iterrows())
    assert lost <= 0.04 * len(fresh)


def test_steps_stop_at_the_first_that_is_not_safe():
    assert quality_rules.last_safe_step({3: 1, 4: 300}, 1000, 9, 0.02, 0.01) == 3
    assert quality_rules.last_safe_step({0: 300}, 1000, 9, 0.02, 0.01) is None
    assert quality_rules.last_safe_step({}, 227, 9, 0.02, 0.01) is None and quality_rules.last_safe_step({}, 228, 9, 0.02, 0.01) == 8


# 3, 4 and 8 against their SQL


@pytest.fixture(scope="module")
def con(docs):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source FROM frame")
    return con


def same(df, found):
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: str([round(float(x), 6) if isinstance(x, (int, float)) and x == x and not isinstance(x, bool) else None if x != x else x for x in row])
    assert sorted(key([r[c] for c in names]) for r in df.collect()) == sorted(map(key, found.fetchall()))


def test_mixing(docs, con, empty):
    got = mixing.plan(docs)
    same(got.select("doc_id", "size", "source_size", "target", "taken"), con.execute(mixing.SQL))
    rows = got.collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter({k: v for k, v in Counter(itertools.chain.from_iterable([r.doc_id] * r.copies for r in rows)).items() if v})
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(empty).count() == 0 and mixing.plan(empty).count() == 0


def test_targets_like_sharing_again_and_again(spark):
    rng = random.Random(4)
    for _ in range(5):
        sizes = {f"s{n}": rng.choice([0, 1, 10, 300, 5000]) for n in range(rng.randint(1, 9))}
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
        want, left, open_ = {s: 0.0 for s in sizes}, 1.5 * sum(sizes.values()), set(sizes)
        while left > 1e-9 and open_:
            total = sum(weight[s] for s in open_)
            for s in open_:
                want[s] += left * weight[s] / total
            over = {s for s in open_ if want[s] >= 2 * sizes[s]}
            left = sum(want[s] - 2 * sizes[s] for s in over)
            want |= {s: 2.0 * sizes[s] for s in over}
            open_ -= over
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(want)


def test_licenses(spark, docs, con, empty):
    odd = [(900, "Intro\nReleased under the MIT license\nmore"), (901, licenses.TEMPLATES["MIT"].lower()), (902, "Copyright 2020 A\n" + licenses.TEMPLATES["ISC"]), (903, "Released under no license at all, sorry"), (904, None), (905, ""), (906, "word " * 9000)]
    rng, known = random.Random(5), licenses.templates()
    broken = known["BSD-3-Clause"].replace(". ", ".\n\n").replace(", ", ",\n# ")
    odd += [(907, prose(rng, 300) + "\n\n" + broken + "\n\n" + prose(rng, 500)), (908, "Copyright 2020 A. Licensed under CC BY-NC 4.0. All of it."), (909, prose(rng, 100) + known["Apache-2.0"] + prose(rng, 9000)), (910, known["GPL-3"][: len(known["GPL-3"]) // 3])]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = licenses.scan(more)
    found = {(r.doc_id, r.license) for r in got.collect()}
    assert {(900, "MIT notice"), (901, "MIT"), (902, "ISC"), (907, "BSD-3-Clause"), (908, "CC-BY-NC-4.0 notice"), (909, "Apache-2.0")} <= found
    assert not {d for d, _ in found} & {903, 904, 905, 906} and (910, "GPL-3") not in found
    frame = more.toPandas()  # noqa: F841
    other = duckdb.connect()
    other.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    same(got, other.execute(licenses.sql()))
    assert licenses.scan(empty).count() == 0


def test_masks_hit_every_window():
    allowed = decontaminate.WINDOW - math.ceil(decontaminate.AGREE * decontaminate.WINDOW)
    for bad in itertools.combinations(range(decontaminate.WINDOW), allowed):
        assert any(all(o + k not in bad for k, b in enumerate(m) if b == "1") for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - len(m) + 1))
    for n in range(decontaminate.LEAST, decontaminate.WINDOW):
        for bad in itertools.combinations(range(n), n - math.ceil(decontaminate.AGREE * n)):
            assert any(all(o + k not in bad for k, b in enumerate(m) if b == "1") for m in decontaminate.MASKS for o in range(n - len(m) + 1))
    for n in range(1, decontaminate.LEAST):
        for bad in itertools.combinations(range(n), n - math.ceil(decontaminate.AGREE * n - 1e-9)):
            assert any(all(k not in bad for k, b in enumerate(m) if b == "1") for m in decontaminate.short_masks(n)) and all(len(m) == n for m in decontaminate.short_masks(n))


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    items = [(n, prose(rng, 30)) for n in range(5)] + [(5, "too short an item"), (6, None), (6, None), (7, prose(rng, 8))]
    changed = items[1][1].split()
    for k in (4, 11, 19):
        changed[k] = "other"
    leaks = [(800, "Before. " + items[0][1].upper() + ", after"), (801, " ".join(changed)), (802, " ".join(items[2][1].split()[:9])), (803, prose(rng, 10) + " " + " ".join(items[3][1].split()[10:24])), (804, items[7 + 1][1])]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(more, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(800, 0), (801, 1), (803, 3), (804, 7)}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, decontaminate.leaks(more, benchmark, broadcast_seeds=0).collect()))
    frame, frame2 = more.toPandas(), benchmark.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    con.execute("CREATE TABLE benchmark AS SELECT item_id::BIGINT AS item_id, text FROM frame2")
    same(got, con.execute(decontaminate.sql()))
    assert decontaminate.clean(docs, benchmark).columns == docs.columns and decontaminate.clean(docs, benchmark).count() == docs.count()
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(more, benchmark.limit(0)).count() == 0


def test_short_benchmark_items(spark):
    items = [(1, "what is a cat"), (2, "Yes."), (3, "name five very large rivers"), (4, "list the six most common words")]
    rows = [(1, "Well, what is a CAT? " + "x " * 30), (2, "what is the cat"), (3, "yes and no"), (4, "name five very long rivers"), (5, "name five long wide rivers"), (6, "list the 6 most common words"), (7, "list 6 most common words"), (8, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        got = decontaminate.leaks(docs, benchmark, broadcast_seeds=most)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (3, 2), (4, 3), (6, 4)}
        assert {r.doc_id for r in decontaminate.clean(docs, benchmark, broadcast_seeds=most).collect()} == {2, 3, 5, 7, 8}
        assert {r.doc_id for r in decontaminate.clean(docs, benchmark, 1, broadcast_seeds=most).collect()} == {2, 5, 7, 8}
    frame, frame2 = docs.toPandas(), benchmark.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    con.execute("CREATE TABLE benchmark AS SELECT item_id::BIGINT AS item_id, text FROM frame2")
    same(decontaminate.leaks(docs, benchmark), con.execute(decontaminate.sql()))


def test_anchors_of_many_buckets():
    """A bucket's anchors grow less and less as buckets become more; together they are the same."""
    rng = random.Random(3)
    batch = pa.RecordBatch.from_pydict({"text": [prose(rng, 400) for _ in range(60)]})
    most, every = [], []
    for bucket in (2, 6, 12):
        found = pa.Table.from_batches(list(suffix_dedup._anchors(iter([batch]), bucket)))
        both = [suffix_dedup._unpacked(p, n) for p, n in zip(found.column("packed").to_pylist(), found.column("n").to_pylist())]
        assert all((v >> np.uint64(48 - bucket) == b).all() for (v, _), b in zip(both, found.column("bucket").to_pylist()))
        most.append(max(found.column("n").to_pylist()))
        every.append(sorted((int(v), int(c)) for values, counts in both for v, c in zip(values, counts)))
    assert every[0] == every[1] == every[2] and most[0] > 5 * most[1] > 5 * most[2]


def test_decontamination_of_rows_without_doc_id(spark):
    rng = random.Random(9)
    item, other = prose(rng, 20), prose(rng, 30)
    rows = [(None, "So: " + item), (None, "Thus: " + item), (None, other), (None, None), (1, item), (1, other), (2, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        assert sorted(map(str, map(tuple, decontaminate.leaks(docs, benchmark, broadcast_seeds=most).collect()))) == ["(1, 5, 13, 20, 20)", "(None, 5, 13, 20, 20)"]
        assert sorted(map(str, map(tuple, decontaminate.clean(docs, benchmark, broadcast_seeds=most).collect()))) == sorted(map(str, [(None, other), (None, None), (2, other)]))


# 5


def brute_classes(rows):
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, w in ((k, words(t)) for k, t in rows.items()) if w}
    top = {k: k for k in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = {k: set() for k in rows}
    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            top[max(find(a), find(b))] = min(find(a), find(b))
            if rows[a] != rows[b]:
                links[a].add(rows[b])
                links[b].add(rows[a])
    return {k: (find(k), len(links[k])) for k in rows}


def near_copies(n, length, changes, seed):
    rng = random.Random(seed)
    base = prose(rng, length).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = rng.choice(WORDS)
        yield " ".join(w)


def test_jaccard_join(spark, empty, monkeypatch):
    texts = [t for _, t, *_ in corpus()] + list(near_copies(60, 100, 3, 1)) + list(near_copies(10, 40, 1, 2))
    rows = dict(enumerate(texts))
    df = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").repartition(3)
    want = brute_classes(rows)
    for part in (256, 16):  # the second deals components into several parts
        monkeypatch.setattr(jaccard_join, "PART", part)
        got = jaccard_join.join(df).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    kept = {r.doc_id for r in jaccard_join.keep_one(df).collect()}
    assert kept == {c for c, _ in want.values()}
    assert jaccard_join.join(empty).count() == 0


def test_repeated_rows_and_nulls_in_the_join(spark):
    text = prose(random.Random(1), 30)
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None), (3, None), (4, " ")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in jaccard_join.join(df).collect())
    assert got == [("1", "None", 0, 4), ("1", "None", 0, 4), ("2", "None", 0, 4), ("3", "3", 0, 1), ("3", "3", 0, 1), ("4", "4", 0, 1), ("None", "None", 0, 4)]


def test_components(spark):
    rng = random.Random(3)
    ties = [(n, n + 1) for n in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    top = {x: x for pair in ties for x in pair}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in ties:
        top[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.member: r.component for r in jaccard_join.components(spark.createDataFrame(ties, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in top)


def test_prefixes_reach_the_recall():
    last = jaccard_join.depths()[-1]
    assert jaccard_join.depths() == [10, 8, 6] and jaccard_join.found_at(0.8, last) >= jaccard_join.RECALL > jaccard_join.found_at(0.8, last + 1)


def test_links_between_pairs_of_close_copies(spark):
    """Groups of four: two pairs of close copies, the pairs about 0.82 alike. A tie to the close copy must not end the search for the other pair."""
    rng, rows = random.Random(23), {}
    for g in range(60):
        base = [rng.choice(WORDS) + str(rng.randrange(5000)) for _ in range(400)]
        other = list(base)
        for k in range(7):
            other[20 + 55 * k] = f"edit{g}x{k}"
        for n, w in enumerate((base, base, other, other)):
            w = list(w)
            if n % 2:
                w[399] = f"tail{g}x{n}"
            rows[4 * g + n] = " ".join(w)
    want = brute_classes(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(df).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert sum(x[1] for x in got.values()) >= 0.99 * sum(x[1] for x in want.values()) > 0 and len({x[0] for x in want.values()}) == 60


def test_join_runs_few_tasks(spark):
    """Every shuffle costs a task for each partition, however few rows there are: with 40 partitions a search for each prefix length ran about 2,100 here, one for all of them about 650."""
    rng = random.Random(31)
    texts = [*near_copies(40, 100, 3, 5), prose(rng, 100)]
    for _ in range(40):  # a chain of revisions
        w = texts[-1].split()
        w[rng.randrange(100)] = f"edit{len(texts)}"
        texts.append(" ".join(w))
    rows = dict(enumerate(texts + [prose(rng, 60) for _ in range(40)]))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few tasks", "op5_jaccard_join")
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(df).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_classes(rows)
    status = spark.sparkContext.statusTracker()
    stages = {x for job in status.getJobIdsForGroup("few tasks") for x in status.getJobInfo(job).stageIds}
    assert sum(found.numCompletedTasks for x in stages if (found := status.getStageInfo(x))) < 1300


def test_contracted_ties_lead_as_far(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "EDGES", 5)
    rng = random.Random(37)
    chain = rng.sample(range(-50, 150), 120)
    ties = [*zip(chain, chain[1:]), *[(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)], (7000, 7000)]
    rng.shuffle(ties)
    first, labels = {}, {r.member: r.component for r in jaccard_join.components(spark.createDataFrame(ties, "a long, b long").repartition(3)).collect()}
    for a, b in ties:  # merged one by one
        x, y = first.setdefault(a, {a}), first.setdefault(b, {b})
        first |= dict.fromkeys(x | y, x | y)
    assert all(labels.get(x, x) == min(group) for x, group in first.items()) and 7000 not in labels
    members, roots = jaccard_join._roots(*np.array(ties).T)
    assert dict(zip(members.tolist(), roots.tolist())) == {x: min(group) for x, group in first.items()}


# 6 and 7


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_tokens.default_path())


def test_ids_are_the_library_s(tokenizer):
    rng = random.Random(7)
    encode = _tokens.encoder(_tokens.default_path())
    odd = ["a", " a", "a ", "a  b", "a\n b", "a \nb", "it's we'll I'M", "x y z", "x  y", "a\x1cb c", "a\x85 b", "1 22 333,4", "<|endoftext|> a", "né naïve ÀÉ", "汉字 かな", "🙂🙂 x", "\t\ttab", "…—", "a" * 3000, "́a b", " ", "\n"]
    odd += ["".join(rng.choice("ab1 .,'\n\té ​汉") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in odd + odd:
        assert np.frombuffer(encode.ids(text), encode.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_descent_holds_few_files(spark, docs, monkeypatch):
    files, stash = [], jaccard_join.stash
    monkeypatch.setattr(jaccard_join, "stash", lambda df: (files.append((df.columns, len((out := stash(df)).inputFiles()))), out)[1])
    with_many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in with_many}
    try:
        for k, v in with_many.items():
            spark.conf.set(k, v)
        members = stash(jaccard_join._members(docs.select("doc_id", "text"), 5).select(F.monotonically_increasing_id().alias("member"), "signature"))
        jaccard_join.forest_components(members, 0.8, 0.999)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    held = [n for columns, n in files if "head" in columns]
    assert held and max(held) <= spark.sparkContext.defaultParallelism


def test_streams_are_the_library_s(tokenizer, monkeypatch):
    rng = random.Random(8)
    encode = _tokens.Encoder(_tokens.default_path())
    monkeypatch.setattr(_tokens, "AT_ONCE", 5)
    monkeypatch.setattr(_tokens, "GATHERED", 7)
    texts = [None, "", " ", "a", " a", "a ", "a  b", "word, word. word... the word's end!?", "a\tb\nc d", "a\x1cb c", "a\x85 b", "<|endoftext|> a", "né naïve ÀÉ. 汉字, 🙂🙂", "Ġ b Ġ"]
    texts += ["".join(rng.choice("abé1 .,!'\n 汉") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for some in (texts, texts[:1], [], ["two words"] * 3):
        ids, offsets = encode.streams(pa.array(some, pa.string()), 7)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*tokenizer.encode(x or "", add_special_tokens=False).ids, 7] for x in some]
    assert not any((encode.after, encode.after.old))  # nothing but texts of unusual white space leaves something in memory


class _Counted:
    """A part of the library that counts the characters it gets."""

    def __init__(self, of):
        self.of, self.n = of, 0

    def tokenize(self, word):
        self.n += len(word)
        return self.of.tokenize(word)

    def encode_batch_fast(self, some, **how):
        self.n += sum(map(len, some))
        return self.of.encode_batch_fast(some, **how)


def test_streams_give_the_library_each_word_once(tokenizer):
    rng = random.Random(9)
    encode = _tokens.Encoder(_tokens.default_path())
    encode.tokenizer, encode.model = _Counted(encode.tokenizer), _Counted(encode.model)
    first, second = (["".join(rng.choices("abdeéilnorst", k=8)) for _ in range(40)] for _ in range(2))
    marks = [".", ",***", "", "'$", "!?"]
    texts = [" ".join(f"{x}{rng.choice(marks)}\n{y}{rng.choice(marks)}" for y in second) for x in first]
    for k in range(3):  # the same words in other orders
        before = encode.tokenizer.n + encode.model.n
        ids, offsets = encode.streams(pa.array(texts), 0)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*x.ids, 0] for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # at most each of the 80 words with a space and without, and the marks
        assert encode.tokenizer.n + encode.model.n - before < (2 * 80 * 12 if k == 0 else 50)
        texts = [" ".join(rng.sample(x.split(" "), 40)) for x in rng.sample(texts, 40)]


@pytest.mark.parametrize("known", [0, 20, 1 << 20])
def test_remembered_words_change_no_ids(tokenizer, monkeypatch, known):
    rng = random.Random(10)
    encode = _tokens.Encoder(_tokens.default_path())
    monkeypatch.setattr(_tokens, "KNOWN", known)
    some = ["a", "bc", "é", "Word", "the", "x" * 50, ".", ",", "'", "***", "\n", "\n\n", "\r\n", "\u00a0", " ", " ", "'s", "$", "-", "1", "٣", "汉", "\u0301"]
    for _ in range(40):
        texts = ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 30))]
        ids, offsets = encode.streams(pa.array(texts), 0)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*x.ids, 0] for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words = {y for x in texts for y in x.replace("\n", " ").split(" ")}
        assert len(encode.known) == len(encode.known_ids) <= max(known, 2 * len(words))


def test_crc_parts():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 5, 400, 77)]
    after = [sum(map(len, parts[k + 1 :])) for k in range(len(parts))]
    shifted = token_store.shifted_crc(np.array([zlib.crc32(p) for p in parts]), np.array(after))
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(b"".join(parts))


def test_token_store(spark, docs, plain, tokenizer, empty, folder):
    token_store.write_store(docs, f"{folder}/a")
    got = token_store.read_digests(spark, f"{folder}/a").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in plain), key=lambda d: (d is not None, d)) and all(r.verified for r in got)
    ids = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in plain)
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(spark, f"{folder}/a").collect()) == ids
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter({(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())): n for (d, x), n in ids.items()})
    chunks = spark.read.parquet(f"{folder}/a/data").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert token_store.sound_manifest(spark, f"{folder}/a").count() == 0
    token_store.write_store(empty, f"{folder}/b")
    assert token_store.read_digests(spark, f"{folder}/b").count() == 0


def test_cuts_follow_the_content():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50257, 20000).astype("<u2")
    a, b = token_store.cuts(ids), token_store.cuts(np.concatenate([ids[:37], ids]))
    assert a[-1] == len(ids) and len({x + 37 for x in a} & set(b)) > 0.8 * len(a)
    assert all(y - x <= token_store.MOST for x, y in zip([0, *a], a)) and token_store.cuts(ids[:0]) == []
    assert max(np.diff([0, *token_store.cuts(np.zeros(9000, "<u2"))])) <= token_store.MOST


def test_cuts_do_not_depend_on_what_is_hashed_at_once(monkeypatch):
    ids = np.random.default_rng(6).integers(0, 50257, 30000).astype("<u2")
    offsets = np.array([0, 0, 5, 9000, 9001, 30000])
    whole = list(token_store.cuts_of(ids, offsets))
    assert sum(map(len, whole)) > 60
    for n in (3, 8, 1000):
        monkeypatch.setattr(token_store, "HASHED", n)
        assert list(token_store.cuts_of(ids, offsets)) == whole


def test_token_counts(spark, docs, plain, tokenizer, empty):
    lengths = np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in plain])
    got = token_counts.answers(token_counts.lengths(docs)).collect()
    assert {r.n_tokens for r in got} == set(lengths.tolist())
    for r in got:
        over = lengths[lengths > r.n_tokens]
        assert (r.n_docs, r.docs_longer, r.tokens_longer, r.tokens_truncated, r.tokens_total) == ((lengths == r.n_tokens).sum(), len(over), over.sum(), np.minimum(lengths, r.n_tokens).sum(), lengths.sum())
        assert r.quantile == pytest.approx((lengths <= r.n_tokens).mean())
    assert token_counts.answers(token_counts.lengths(empty)).count() == 0
    limits = spark.createDataFrame([(0,), (3,), (int(lengths.max()) + 999,), (17,), (17,), (None,)], "n_tokens long")
    asked = {r.n_tokens: r for r in token_counts.answers_for(token_counts.lengths(docs), limits).collect()}
    assert set(asked) == {0, 3, lengths.max() + 999, 17}
    for limit, r in asked.items():
        assert (r.docs_longer, r.tokens_longer, r.tokens_truncated) == ((lengths > limit).sum(), lengths[lengths > limit].sum(), np.minimum(lengths, limit).sum())
        assert r.quantile == pytest.approx((lengths <= limit).mean())
    assert {(r.tokens_total, r.quantile) for r in token_counts.answers_for(token_counts.lengths(empty), limits).collect()} == {(0, None)}


# 9 and 10


def test_quadratic(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    got = quadratic.op9_quadratic(spark, d).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in zip(got.doc_id, got.held_out))
    none = quadratic.classify(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.5}
    assert quadratic.classify(empty, labels).count() == 0


def test_quadratic_against_direct_densities(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(("Word" if k % 2 else "w#rd,")[: int(n)] for n in rng.integers(1, 5, int(rng.integers(5, 40)))), k % 2) for k in range(200)]
    rows += [rows[7], rows[8], (900, rows[6][1], 0), (901, None, 1), (902, "long " * 30000, 1)]  # repeated rows, equal texts, odd texts
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quadratic.classify(df, df.select("doc_id", "quality")).collect()
    x = quadratic.features({n: np.array(v) for n, v in zip(_stats.NAMES, zip(*_stats.rows(pa.array([r[1] for r in rows], pa.string()))))})
    learned = np.array([zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows])
    mark = np.array([r[2] for r in rows])
    cov = {k: np.cov(x[learned & (mark == k)].T, bias=True) for k in (0, 1)}
    n = {k: (learned & (mark == k)).sum() for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    pooled += np.diag(np.diag(pooled) * 0.01 + 1e-4)
    log = {}
    for k in (0, 1):
        own = (1 - quadratic.SHRINK) * cov[k] + quadratic.SHRINK * pooled
        own = (1 - quadratic.DIAGONAL) * own + quadratic.DIAGONAL * np.diag(np.diag(own)) + 1e-4 * np.eye(len(own))
        y = x - x[learned & (mark == k)].mean(0)
        log[k] = -0.5 * (np.einsum("ij,jk,ik->i", y, np.linalg.inv(own), y) + np.linalg.slogdet(own)[1])
    odds = quadratic.TEMPER * (log[1] - log[0]) + np.log(n[1]) - np.log(n[0])
    want = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    near = lambda pairs: [(k, round(v, 6)) for k, v in sorted(pairs)]
    assert near((r.doc_id, r.score) for r in got) == near((r[0], float(v)) for r, v in zip(rows, want))


def test_forward_sums_all_segmentations():
    path = language_id.default_path()
    model = np.random.default_rng(1).uniform(1e-4, 1e-2, (len(language_id.vocabulary(path)[0]) + 1, 2))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted(x for x in {sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))})
    number = {x: k for k, x in enumerate(names)}

    def total(word):
        if not word:
            return 1.0
        return sum(model[number.get(word[:n], -1)] * total(word[n:]) for n in range(1, len(word) + 1) if n == 1 or word[:n] in number)

    for word in ("the", "straße", "汉字x", "a", "reading"):
        assert np.exp(language_id.word_scores([word], model, path)[0]) == pytest.approx(total("▁" + word))
    counts = np.array([[3.0, 1.0]])
    pieces = language_id.expected_pieces(["the"], counts, model, path)
    eps = 1e-6
    for piece in (number["▁the"], number["t"]):
        bumped = model.copy()
        bumped[piece] *= 1 + eps
        slope = (language_id.word_scores(["the"], bumped, path) - language_id.word_scores(["the"], model, path))[0] / eps
        assert pieces[piece] == pytest.approx(slope * counts[0], rel=1e-3)


def test_long_pieces_and_long_words_are_summed_whole(monkeypatch):
    import sentencepiece

    path = language_id.default_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted({sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))})
    number = {x: k for k, x in enumerate(names)}
    model = np.random.default_rng(2).uniform(1e-4, 1e-2, (len(names) + 1, 2))

    def total(word):
        sums = [np.ones(2)]
        for end in range(1, len(word) + 1):
            sums.append(sum(sums[a] * model[number.get(word[a:end], -1)] for a in range(end) if end - a == 1 or word[a:end] in number))
        return sums[-1]

    found = ["function", "different", "translation", "internationalization" * 3, "汉字translation" * 4, "translation" * 5, "x"]
    assert max(map(len, names)) > 8
    for stride in (language_id.STRIDE, 40):
        monkeypatch.setattr(language_id, "STRIDE", stride)
        scores = language_id.word_scores(found, model, path)
        assert np.allclose(scores, [np.log(total("▁" + w)) for w in found])
        counts = np.array([[1.0, 2.0], [2.0, 0.5]])
        pieces = language_id.expected_pieces(found[3:5], counts, model, path)
        for piece in ("translation", "n", "▁inter"):
            bumped = model.copy()
            bumped[number[piece]] *= 1 + 1e-6
            slope = (language_id.word_scores(found[3:5], bumped, path) - language_id.word_scores(found[3:5], model, path)) / 1e-6
            assert pieces[number[piece]] == pytest.approx((slope * counts).sum(0), rel=1e-3)
    assert np.isfinite(language_id.word_scores(["qz" * 5000], model, path)).all()


def test_language_id(spark, docs, empty):
    got = language_id.op10_language_id(spark, "/root/testdata/sf0.001").join(_shared.documents(spark, "/root/testdata/sf0.001", "doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.93 and got.score.between(0, 1).all()
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert {odd[n] for n, t, *_ in corpus() if not t or not any(map(str.isalpha, t))} == {"und"} and set(odd.values()) <= {"en", "de", "und"}
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_more_languages_than_one_block(spark, monkeypatch):
    """Blocks of languages give what one matrix gives; of equally likely languages the first by name is taken, across blocks too."""
    rng = random.Random(12)
    names = ["en", "de", "fr", "aa", "zz", "mm", "bb"]
    rows = []
    for n in range(280):
        lang = names[n % 7]
        style = {"aa": "en", "zz": "en"}.get(lang, lang)  # aa, en and zz are the same language
        rows.append((n, " ".join("".join(rng.choice({"en": "etaoin", "de": "nirstü", "fr": "éèaslu", "mm": "mnmwvx", "bb": "bpdqbo"}[style]) for _ in range(rng.randint(2, 6))) for _ in range(12)), lang))
    rows += [(900, None, "en"), (901, "123 456", "de"), (902, "etaoin " * 400, None), (903, "mnmwvx" * 3000, None), (904, "x", "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs).collect()}
    for at_once in (3, 1):
        monkeypatch.setattr(language_id, "AT_ONCE", at_once)
        assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs).collect()} == want
    right = [want[n][0] == {"zz": "aa", "en": "aa"}.get(lang, lang) for n, t, lang in rows[:280] if lang not in ("en", "aa", "zz")]
    assert sum(right) > 0.9 * len(right) and want[900] == want[901] == ("und", 0.0) and want[903][0] == "mm"


def test_equally_likely_languages(spark):
    rows = [(n, "word text", lang) for n in range(60) for lang in ("b", "a")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r.lang_pred, round(r.score, 6)) for r in got} == {("a", 0.5)}


def test_1200_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(n, f"{letters[n % 26]}{letters[n // 26 % 26]}qx{letters[n // 676 % 26]} " * 3, f"l{n % 1200:04d}") for n in range(3600)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert len(got) == 3600 and len({r.lang_pred for r in got}) > 600 and all(0 <= r.score <= 1 for r in got)


# All


def test_very_long_texts_ties_and_clashing_names(spark, tokenizer):
    rng = random.Random(31)
    long = prose(rng, 20000)
    rows = [(1, long, "en", "a"), (2, long + " end", "de", "a"), (3, "x" * 300_000, "en", None), (4, "汉" * 20_000, None, "b"), (5, long, "en", "b"), (5, long, "en", "b"), (6, "\n" * 50_000 + "one", "fr", "b"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("document", "copies", "member", "component", "signature", "tokens", "item", "found", "held_out", "stratum", "text_key", "size", "mix_source", "quality", "runs"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(9, " ".join(long.split()[15000:15020]))], "item_id long, text string")
    verdicts = {r.doc_id: r for r in quality_rules.rule_verdicts(docs, labels).collect()}
    assert verdicts[1].n_words == 20000 and verdicts[3].word_chars == 300_000 and verdicts[None].n_words == 0
    assert {r.doc_id for r in decontaminate.leaks(docs, benchmark).collect()} == {1, 2, 5}
    classes = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_join.join(docs).collect()]
    assert sorted(classes, key=str) == sorted([(1, 1, 1, 3), (2, 1, 1, 1), (3, 3, 0, 1), (4, 4, 0, 1), (5, 1, 1, 3), (5, 1, 1, 3), (6, 6, 0, 1), (None, None, 0, 1)], key=str)
    assert {r["size"] for r in mixing.plan(docs.drop("size")).collect()} == {20000, 20001, 1, 0}
    want = Counter(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    assert {r.n_tokens: r.n_docs for r in token_counts.lengths(docs).collect()} == want
    assert len(quadratic.classify(docs, labels).collect()) == len(rows) and len({r.score for r in quadratic.classify(docs, labels).collect() if r.doc_id in (1, 5)}) == 1
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}[None] == "und"
    assert suffix_dedup.dedup(docs).count() == len(rows) and licenses.scan(docs).count() == 0
    for kept in (quality_rules.keep(docs, labels), jaccard_join.keep_one(docs), decontaminate.clean(docs, benchmark), mixing.mix(docs.drop("size"))):
        assert set(kept.columns) <= set(docs.columns) and kept.count() > 0


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = _shared.documents(spark, d)
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = _shared.stash(stage(spark, seen, d))
        if k < 4:
            assert out.columns == docs.columns
        before, after = [r.doc_id for r in seen.select("doc_id").collect()], [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= set(before)
        if k == 0:
            assert set(after) == {r.doc_id for r in quality_rules.op2_quality_rules(spark, d).filter("kept").collect()}
        if k == 1:
            assert set(after) == {c for c, _ in brute_classes({r.doc_id: r.text for r in seen.collect()}).values()}
        if k == 2:
            assert set(before) - set(after) == {r.doc_id for r in decontaminate.leaks(seen, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
        if k == 3:
            assert max(Counter(after).values()) <= 2
        if k == 4:
            assert len(after) == len(before) and out.filter("verified").count() == len(after)
        seen = out


def test_the_pipeline_s_rules_reject(spark, folder):
    """With enough labels rules beyond the base statistics are active, and what they reject does not reach the later stages."""
    import corpus_pipeline

    rng = random.Random(8)
    good = [" ".join(rng.choice(WORDS) + rng.choice("abcdefghijkl") + rng.choice("mnopqrstuvwx") for _ in range(rng.randint(60, 120))) for _ in range(620)]
    bad = [" ".join(rng.choice(["###", "$$$", "&&&", "***", "|||"]) + rng.choice(WORDS) + rng.choice("abcdefghijkl") + rng.choice("mnopqrstuvwx") for _ in range(rng.randint(60, 120))) for _ in range(120)]
    rows = [(n, t, "en", "s1", len(t)) for n, t in enumerate(good + bad)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, int(n < len(good)), 0) for n in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(good[5].split()[10:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    verdicts = {r.doc_id: r for r in quality_rules.op2_quality_rules(spark, folder).collect()}
    out = {r.doc_id for r in verdicts.values() if not r.kept}
    assert not any(r.base_failed for r in verdicts.values()) and len(out & set(range(len(good), len(rows)))) > 60 and len(out & set(range(len(good)))) < 30
    stored = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    assert stored and not stored & out and 5 not in stored and len(stored) > 500


def test_decontamination_holds_no_long_text_for_each_hit(spark, docs, monkeypatch):
    """A text of 40,000 tokens with a hit at nearly every place: when each hit had all of its text's tokens in memory, that were 1.6 billion tokens. And pieces of any size find the same."""
    passage = " ".join(f"w{k}" for k in range(40))
    benchmark = spark.createDataFrame([(5, passage), (6, "v1 v2 v3 v4 v5 v6 v7 v8"), (7, "only")], "item_id long, text string")
    long = spark.createDataFrame([(1, " ".join([passage] * 1000)), (2, "v0 v1 v2 v3 v4 v5 v6 v7 x8 only"), (3, passage[4:].replace("w9 ", "z ")), (4, passage[:-9]), (5, "w0 w1"), (6, None)], "doc_id long, text string")
    want = [(1, 5, 13, 40, 40), (2, 6, 7, 7, 8), (2, 7, 1, 1, 1), (3, 5, 13, 37, 40), (4, 5, 13, 37, 40)]
    assert sorted(map(tuple, decontaminate.leaks(long, benchmark).collect())) == want
    few = long.filter("doc_id > 1").unionByName(docs.select("doc_id", "text").limit(60))
    many = benchmark.unionByName(docs.filter("length(text) > 90").selectExpr("doc_id + 100 AS item_id", "substring(text, 7, 80) AS text").limit(20))
    found = sorted(map(str, decontaminate.leaks(few, many).collect()))
    monkeypatch.setattr(decontaminate, "PLACES", 3)
    assert found and found == sorted(map(str, decontaminate.leaks(few, many).collect())) == sorted(map(str, decontaminate.leaks(few, many, broadcast_seeds=0).collect()))


def test_one_mask_is_enough_for_long_items():
    """Items of a window or more have one mask where it hits each window by itself, as trying all shows; shorter ones have all."""
    assert decontaminate.needed([], decontaminate.MASKS) == [(0, "11011", 7, None)]
    assert decontaminate.needed([3, 9], decontaminate.MASKS)[:2] == [(0, "11011", 7, None), (1, "1101001", 7, 12)]
    for mask in (*decontaminate.MASKS, "111", "110100101"):
        for window, agree in ((13, 0.8), (13, 0.9), (10, 0.8), (20, 0.8), (7, 0.8), (13, 1.0)):
            differ = window - math.ceil(agree * window - 1e-9)
            hit = all(any(all(o + k not in bad for k, b in enumerate(mask) if b == "1") for o in range(window - len(mask) + 1)) for bad in itertools.combinations(range(window), differ))
            assert hit or not decontaminate.alone(mask, window, agree)


def test_bitmaps_grow_with_the_corpus(spark, monkeypatch, docs):
    """At 6 GB of files some 100 million anchors recur, which filled the 64 million bits that there were for any corpus, and all segments passed."""
    for gigabytes, bits in ((0.1, 1 << 26), (0.5, 1 << 26), (1, 1 << 27), (6, 1 << 29), (100, 1 << 29)):
        monkeypatch.setattr(suffix_dedup, "version", lambda _: [("a", int(gigabytes * 4e8), 0), ("b", int(gigabytes * 6e8), 0)])
        assert suffix_dedup.bitmap_bits(docs) == bits


def test_meeting_keys_are_spread():
    """Anchors are least hashes, so that their upper halves are few: a million of these met in 1,868 fewer places, now in 107 fewer."""
    rng = np.random.default_rng(5)
    anchors = np.full(1_000_000, np.iinfo(np.uint64).max)
    for _ in range(31):
        anchors = np.minimum(anchors, rng.integers(0, np.iinfo(np.uint64).max, len(anchors), np.uint64))
    assert len(np.unique(suffix_dedup._meeting(anchors))) > 0.9995 * len(np.unique(anchors)) > len(np.unique(anchors >> np.uint64(32)))


def test_copies_alone_under_their_key(spark):
    """Exact copies, the first of them in another partition than the rest, meet alone; texts that cross them meet several segments. Against all pairs of windows."""
    rng = random.Random(77)
    base = [prose(rng, 60) for _ in range(6)]
    texts = [base[0], base[1], base[0], base[2] + " " + base[0][40:200], base[1], base[3], base[3][:99], base[4] * 2, base[0], "tail " + base[5], base[5], base[5][7:]]
    rows = spark.createDataFrame([(100 - n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want, seen = {}, {}
    for doc, text in sorted((100 - n, t.encode()) for n, t in enumerate(texts)):
        gone = bytearray(len(text))
        for k in range(len(text) - 49):
            if seen.setdefault(text[k : k + 50], doc) < doc:
                gone[k : k + 50] = b"\x01" * 50
        want[doc] = (sum(gone), len(re.findall(rb"\x01+", bytes(gone))))
    for parameters in ({}, {"bits": 64}, {"bits": 1 << 12, "hot": 2}):
        got = suffix_dedup.dedup(rows, **parameters).collect()
        assert {r.doc_id: (r.n_removed, r.n_spans) for r in got} == want and sum(n for n, _ in want.values()) > 1000
