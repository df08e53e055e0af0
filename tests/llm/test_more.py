"""Operators 11 to 13 against brute force and SQL, on small tables with nulls, ties, long and odd texts."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lorekeep.llm import hard_negatives, periodic_runs, simhash
from lorekeep.llm._shared import span_hashes, word_spans

SCHEMA = "doc_id long, text string, lang string, bits long, n_runs int, component string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(50)]
    texts += [texts[3], texts[3].upper(), texts[4] + " tail", texts[5].replace("a", "A", 1), None, None, "", "  \n ", "É É é Ünd " * 9, "one two", "Two", "x " * 700, "a b " * 60 + "c " * 40, "ab\tab\n" * 500]
    for _ in range(20):
        w = split(prose(rng, 150))
        for _ in range(rng.randint(1, 3)):
            a, p = rng.randrange(120), rng.randint(1, 12)
            m = rng.randint(24, 80)
            w[a : a + m] = (w[a : a + p] * 80)[:m]
        texts.append("  ".join(w))
    out = [(n, t) for n, t in enumerate(texts)]
    return [*out, out[2], (None, texts[0]), (None, None), (7, texts[1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", 1, 2, "x") for k, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def brute_fingerprint(text):
    w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            top[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, i in enumerate(ids):
        groups.setdefault(find(k), []).append(i)
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(ids))]


@pytest.mark.parametrize("most", [simhash.LIST, 2])
def test_simhash(docs, rows, empty, most, monkeypatch):
    prints = [brute_fingerprint(t) for _, t in rows]
    names = brute_components([k for k, _ in rows], prints)
    want = sorted(str((k, f"{p:016x}", c)) for (k, _), p, c in zip(rows, prints, names))
    monkeypatch.setattr(simhash, "CHUNK", 16)
    got = simhash.near_duplicates(docs, most).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == want
    assert {r.n_copies for r in got if r.fingerprint == "0" * 16} == {prints.count(0)}
    assert simhash.near_duplicates(empty).count() == 0


def test_half_is_not_over_half():
    counts = np.array([2, 3] + [0] * 62)
    assert simhash.fingerprint(counts, 4) == 0b10 and simhash.fingerprint(np.zeros(64, np.int64), 0) == 0


@pytest.mark.parametrize("most", [4, 10_000])
def test_links_between_planted_fingerprints(spark, most):
    """Chains, stars and dense balls of fingerprints, in short lists and in lists that are split by two more bytes."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):  # a walk of one to three bits a step, so that some steps are too far
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))))
            prints.add(x)
    ball = rng.getrandbits(64)
    prints |= {ball ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(rng.sample(range(64), 14), 2)}
    prints = sorted(prints)
    names = brute_components(prints, prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    tied = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.ties(spark.createDataFrame([(x,) for x in signed], "bits long"), most).collect()]
    assert all(names[prints.index(a)] == names[prints.index(b)] for a, b in tied)
    top = {x: x for x in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in tied:
        top[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(x) for x in prints] == names and len(set(names)) > 150


def test_every_link_shares_a_list():
    rng = random.Random(6)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 2))
        shares = lambda masks: any((a ^ b) & (m % (1 << 64)) == 0 for m in masks)
        assert shares(simhash.FOUR) and shares(simhash.SIX)
        assert sum((a >> 8 * k & 255) == (b >> 8 * k & 255) for k in range(8)) >= simhash.SHARED
    assert all(bin(m % (1 << 64)).count("1") == 48 for m in simhash.SIX) and len(set(simhash.SIX)) == 28


# 12


def brute_runs(w, least=24, times=3):
    found, n = {}, len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, times * p):
                found.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_report(doc_id, text):
    w = split(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("portion", [periodic_runs.PAIRS, 40])
def test_periodic_runs(docs, rows, empty, portion, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", portion)
    monkeypatch.setattr(periodic_runs, "CHUNK", 50)
    want = [brute_report(k, t) for k, t in rows]
    got = periodic_runs.detect(docs, planted=True).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and sum(r.n_runs for r in got) > 30
    assert periodic_runs.detect(empty).count() == 0


def _words(text, hashes=None):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return periodic_runs.Words(raw, starts, ends, span_hashes(data, starts, ends) if hashes is None else np.full(len(starts), hashes, np.uint64))


def test_runs_of_small_alphabets():
    rng = random.Random(8)
    for _ in range(400):
        w = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 110))]
        if len(w) > 30:
            a, p = rng.randrange(20), rng.randint(1, 12)
            w[a : a + 60] = (w[a : a + p] * 60)[:60]
        assert periodic_runs.runs(_words(" ".join(w))) == brute_runs(w)


def test_words_decide_where_hashes_meet():
    """With one hash for all words every stretch is a chance meeting; words are compared."""
    rng = random.Random(9)
    for _ in range(30):
        w = [rng.choice("ab") for _ in range(90)]
        a, p = rng.randrange(20), rng.randint(1, 9)
        w[a : a + 50] = (w[a : a + p] * 60)[:50]
        assert periodic_runs.runs(_words(" ".join(w), hashes=1)) == brute_runs(w)


def test_a_long_text_of_one_word():
    assert periodic_runs.runs(_words("w " * 60_000)) == [(0, 60_000, 1)]


# 13


def vectors(seed=3, n=700):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rng.normal(size=8) * rng.choice([0.2, 1, 3])
        out.append((k, [float(x) for x in np.float32(v)], int(rng.integers(0, 4))))
    for k in range(n, n + 60):  # ties
        out.append((k, out[5][1], k % 4))
    nan = float("nan")
    out += [(800, None, 1), (801, out[1][1], None), (802, [nan] * 8, 1), (803, [1.0, None] + [0.0] * 6, 1), (804, [float("inf")] * 8, 2), (805, [0.0] * 8, 1), (900, [0.0] * 8, 2), (1000, [-x for x in out[0][1]], 9), (1100, out[0][1], 9)]
    return out


EMB = "vec_id long, embedding array<float>, label int, anchor string, norm int"


def brute_negatives(rows):
    e = {k: (label, np.floor(256 * np.float64(v)).astype(object)) for k, v, label in rows if v is not None and label is not None and None not in v and np.isfinite(v).all()}
    out = []
    for a, (label, v) in e.items():
        if a % 100:
            continue
        score = {k: int(sum(x * y for x, y in zip(map(int, v), map(int, u)))) for k, (_, u) in e.items() if k != a}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if e[k][0] == label][:5]:
            hard = [k for k in order if e[k][0] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]][:10]
            out += [(a, p, n, k, score[p], score[k]) for n, k in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e3, 1e5])
def test_hard_negatives(spark, scale, monkeypatch):
    """The larger scales need double precision and whole numbers. A repeated row counts once."""
    monkeypatch.setattr(hard_negatives, "BUCKET", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    found = [(k, v if v is None else [None if x is None else float(np.float32(x * scale)) for x in v], label) for k, v, label in vectors()]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*found, found[10], found[100]]] + [(None, found[0][1], 1, "x", 1)], EMB).repartition(3)
    got = hard_negatives.mine(df, stripe=100)
    want = brute_negatives(found)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_hard_negatives_against_sql(spark, folder):
    found = vectors(4)
    df = spark.createDataFrame(found, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = hard_negatives.op13_hard_negatives(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(hard_negatives.SQL).fetchall())


def test_the_bound_ends_a_search():
    """Buckets behind the bound are not multiplied, and leave out nothing that counts."""
    rng = np.random.default_rng(1)
    vecs = (rng.normal(size=(4000, 8)) * np.linspace(400, 1, 4000)[:, None]).astype(np.int64)
    norm = np.sqrt((vecs.astype(float) ** 2).sum(1))
    table = pa.table({"vec_id": np.arange(4000), "label": np.arange(4000) % 3, "norm": norm, "vector": pa.array(list(map(list, vecs.tolist())))})
    buckets = hard_negatives.Buckets(table, 100)
    asked = {"vec_id": np.arange(5), "label": np.arange(5) % 3, "norm": norm[:5], "vector": vecs[:5]}
    met = []
    real = hard_negatives.products
    try:
        hard_negatives.products = lambda a, b, largest: met.append(len(b)) or real(a, b, largest)
        at, j, score, ids = hard_negatives.search(asked, buckets, np.full((5, 1), hard_negatives._LOW), np.full((5, 1), hard_negatives._HIGH), 4, True)
    finally:
        hard_negatives.products = real
    assert sum(met) < 2500
    full = vecs[:5] @ vecs.T
    for a in range(5):
        order = [k for k in np.lexsort((np.arange(4000), -full[a])) if k != a and k % 3 == a % 3][:4]
        assert ids[at == a].tolist() == order and score[at == a].tolist() == full[a][order].tolist()
