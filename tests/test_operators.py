"""Worked examples of ranking, writes, chunks, files and the bank."""

import os
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import chunk, evaluate, fusion, index, keyword, lifecycle, promotion, snippets, sync, vector
from lorekeep.plans import search
from lorekeep.sources import bank, files, tables
from lorekeep.streaming import events as ev


def lists(spark, *ranked, weights=None):
    rows = [(n, float((weights or [1] * len(ranked))[n]), i + 1, x, x) for n, r in enumerate(ranked) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "list_no int, weight double, rank int, id string, path string").withColumn("q", F.lit(0))


def test_rrf(spark):
    out = {r.id: r.score for r in fusion.rrf(lists(spark, "ab", "ba", weights=[2, 1]), 30, "q").collect()}
    assert out["a"] == 1.0 and out["b"] < 1.0
    out = [(r.id, r.score) for r in fusion.rrf(lists(spark, "ab"), 60, "q").orderBy("rank").collect()]
    assert out == [("a", 1.0), ("b", pytest.approx(61 / 62))]
    assert [r.id for r in fusion.rrf(lists(spark, "abc"), 10, "q", min_score=0.9).orderBy("rank").collect()] == ["a", "b"]


def candidates(spark, *rows):
    return spark.createDataFrame([(0, x, f, f or x, k, s) for x, f, k, s in rows], "q int, id string, source_file string, path string, chunk_index int, score double")


def test_affinity(spark):
    rows = candidates(spark, ("a", "f", 0, 1.0), ("b", "f", 1, 0.9), ("c", "g", 0, 0.8))
    out = {r.id: r.ranking for r in fusion.consolidate(fusion.affinity(rows, 0.1, 0.1, "q"), 0.2, "q").collect()}
    assert out == {"a": pytest.approx(1.0), "b": pytest.approx(1.0 / 1.1), "c": pytest.approx(0.8 / 1.1)}  # 1.0 + 0.1, 0.9 + 0.1 and 0.8, divided by the largest
    total = {r.id: r.doc_score for r in fusion.affinity(rows, 0.1, 0.1, "q", total=True).collect()}
    assert total == {"a": pytest.approx(sum(r.boosted for r in fusion.affinity(rows, 0.1, 0.1, "q").collect() if r.source_file == "f")), "b": pytest.approx(total["a"]), "c": pytest.approx(0.8)}
    rows = candidates(spark, ("a", "f", 0, 1.0), ("b", "f", 1, 0.7), ("c", None, 0, 0.9))
    assert {r.id for r in fusion.consolidate(fusion.affinity(rows, 0.1, 0.1, "q"), 0.1, "q").collect()} == {"a", "c"}


def test_bm25_agrees_with_sqlite(spark):
    sqlite3 = pytest.importorskip("sqlite3")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(value, source_file, section)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    rng = random.Random(3)
    words = "alpha beta gamma delta naïve Größe file_1 zeta eta".split()
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(1, 30))), f"docs/{rng.choice(words)}.md", rng.choice(words)) for n in range(1, 60)]
    con.executemany("INSERT INTO t(rowid, value, source_file, section) VALUES (?, ?, ?, ?)", rows)
    entries = spark.createDataFrame(rows, "id long, value string, source_file string, section string")
    kept = index.built(entries)
    phrases = [" ".join(re.findall(r"[^\W_]+", r[1].lower())[:n]) for n, r in ((3, rows[4]), (4, rows[9]), (6, rows[12]), (5, rows[20]))]
    for terms in (["alpha", "große", "beta gamma"], ["alpha", *phrases], phrases[1:3], ["beta beta", "beta beta beta"]):
        match = " OR ".join(f'"{t}"' for t in terms)
        want = dict(con.execute("SELECT rowid, -bm25(t, 1.0, 8.0, 16.0) FROM t WHERE t MATCH ?", (match,)))
        asked = spark.createDataFrame([(0, [t.replace("ï", "i").replace("ö", "o") for t in terms])], "query_id int, terms array<string>")
        got = {r.id: r.score for r in keyword.any_of(asked, kept).collect()}
        assert got.keys() == want.keys() and got and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def random_bank(rng, n, first=0):
    words = [f"w{k}" for k in range(60)]
    return [(first + k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40))), f"d/{rng.choice(words)}.md", rng.choice(words), f"c{k % 3}") for k in range(n)]


BANK = "id long, value string, source_file string, section string, ctx string"


def test_the_k_best_are_the_first_of_all_hits(spark, monkeypatch):
    """With small segments, several stripes and contexts; ties go to the smaller id; blocks are skipped."""
    monkeypatch.setattr(index, "SEGMENT", 40)
    monkeypatch.setattr(keyword, "BLOCK", 4)
    rng = random.Random(17)
    kept = index.built(spark.createDataFrame(random_bank(rng, 700) + [(900 + k, "w40 w41 w42", "d/w1.md", "w2", "c0") for k in range(30)], BANK).repartition(3))
    assert kept.entries == 730 and kept.segments >= 19
    asked = spark.createDataFrame([(k, 0, False, rng.sample([f"w{j}" for j in range(60)], rng.randint(1, 9)) + ["w40 w41"], ["c1"] if k % 5 == 0 else None) for k in range(25)], "query_id long, searched int, every boolean, terms array<string>, only array<string>")
    contexts = ["c0", "c1"]
    every = keyword.search(asked, kept, None, contexts=contexts)
    want = keyword.ranked(every, 7, "query_id", "ctx").select("query_id", "ctx", "id", F.round("score", 9).alias("score"), "rank")
    got = keyword.ranked(keyword.search(asked, kept, 7, contexts=contexts), 7, "query_id", "ctx").select("query_id", "ctx", "id", F.round("score", 9).alias("score"), "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 250
    blocks = keyword.search(asked, kept, 3, contexts=contexts, counted=True).agg(F.sum("blocks_met"), F.sum("blocks_read")).first()
    assert 0 < blocks[1] < blocks[0]
    strict = asked.withColumns({"every": F.lit(True), "terms": F.slice("terms", 1, 2)})
    some = {(r.query_id, r.id) for r in keyword.search(strict, kept, contexts=contexts).collect()}
    one = [{(r.query_id, r.id) for r in keyword.search(asked.withColumn("terms", F.slice("terms", n, 1)), kept, contexts=contexts).collect()} for n in (1, 2)]
    singles = {r.query_id for r in asked.filter("size(terms) = 1").collect()}
    assert {x for x in some if x[0] not in singles} == {x for x in one[0] & one[1] if x[0] not in singles}


def test_release_drops_what_one_use_has_written(spark, folder):
    df = spark.createDataFrame([(1,)], "x long")
    kept, path = tables.stash(df), tables.saved(df)
    assert kept.count() == 1 and tables.exists(spark, path)
    tables.release(spark)
    assert not tables.exists(spark, path) and tables.stash(df).count() == 1


def test_segments_lie_evenly_on_stripes(spark):
    numbers = [(g << 52) + (task << 28) + n for g in range(3) for task in range(16) for n in range(4)]
    rows = spark.createDataFrame([(x,) for x in numbers], "segment long")
    for stripes in (1, 4, 8, 16):
        loads = [r["count"] for r in rows.groupBy(index.dealt(stripes).alias("stripe")).count().collect()]
        assert loads == [len(numbers) // stripes] * stripes
    few = rows.filter("segment < shiftleft(6L, 28)").groupBy(index.dealt(16)).count()  # six tasks of one generation
    assert sum(r["count"] for r in few.collect()) == 24
    assert spark.range(1).select(F.lit(1 << 52).alias("segment")).select(index.dealt(7).alias("s")).first().s in range(7)


def test_an_index_kept_by_deltas(spark, folder, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 50)
    rng = random.Random(5)
    old = random_bank(rng, 300)
    now = [r for r in old if r[0] % 10 != 3]
    now = [(r[0], "quite other words w1 w2 w2", *r[2:]) if r[0] % 10 == 4 else (*r[:4], "c9") if r[0] == 55 else r for r in now] + random_bank(rng, 30, 1000)
    df = lambda rows: spark.createDataFrame(rows, BANK)
    index.build(df(old), f"{folder}/ix")
    tokenised = []
    real = index.segments
    monkeypatch.setattr(index, "segments", lambda entries, gen: tokenised.append(entries.count()) or real(entries, gen))
    kept = index.maintain(df(now), f"{folder}/ix")
    fresh = index.built(df(now))
    assert tokenised == [30 + 1 + 30, len(now)] and (kept.entries, kept.tokens) == (fresh.entries, fresh.tokens) == (len(now), fresh.tokens)
    asked = spark.createDataFrame([(0, ["w1", "w5", "w2 w2", "quite"]), (1, ["w30"])], "query_id long, terms array<string>")
    both = [sorted((r.query_id, r.id, round(r.score, 9)) for r in keyword.any_of(asked, x).collect()) for x in (kept, fresh, index.read(spark, f"{folder}/ix"))]
    assert both[0] == both[1] == both[2] and both[0]
    again = index.maintain(df(now), f"{folder}/ix")  # nothing has changed
    assert len(tokenised) == 2 and again.entries == kept.entries
    back = index.maintain(df(old), f"{folder}/ix")  # and a second generation on top
    assert sorted((r.query_id, r.id, round(r.score, 9)) for r in keyword.any_of(asked, back).collect()) == sorted((r.query_id, r.id, round(r.score, 9)) for r in keyword.any_of(asked, index.built(df(old))).collect())
    monkeypatch.setattr(index, "MOST_GENERATIONS", 3)
    rebuilt = index.maintain(df(now), f"{folder}/ix")
    assert rebuilt.dead is None and rebuilt.entries == len(now) and index.read(spark, f"{folder}/none") is None
    assert keyword.any_of(asked, index.built(df(now).limit(0))).count() == 0


def test_a_list_that_fails_while_it_runs(spark, folder):
    """A file of the index is deleted after planning: the vector list answers alone, with a warning. What is asked wrongly is an error."""
    rng = random.Random(2)
    df = spark.createDataFrame([(*r, r[2], f"h{r[0]}", 0, [rng.gauss(0, 1) for _ in range(4)]) for r in random_bank(rng, 60)], BANK + ", path string, hash string, chunk_index int, embedding array<float>")
    kept = index.build(df, f"{folder}/ix")
    asked, vectors = spark.createDataFrame([(1, "w1 w2")], "query_id long, text string"), spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.5])], "query_id long, vector array<float>")
    warned = []
    both = search.hybrid(df, asked, vectors, ["c0", "c1"], index=kept, warned=warned).collect()
    assert both and not warned
    for d, _, names in os.walk(f"{folder}/ix/segments"):
        for name in names:
            if name.endswith(".parquet"):
                os.remove(os.path.join(d, name))
    alone = search.hybrid(df, asked, vectors, ["c0", "c1"], index=kept, warned=warned).collect()
    only = search.hybrid(df, asked, vectors, ["c0", "c1"], search.Parameters(keyword_weight=0.0)).collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, only)) != sorted(map(tuple, both)) and [r.modality for r in search.warnings(spark, warned).collect()] == ["keyword"]
    with pytest.raises(RuntimeError):
        search.hybrid(df, asked, vectors, ["c0"], search.Parameters(vector_weight=0.0), index=kept)
    with pytest.raises(AnalysisException):
        search.hybrid(df.drop("path"), asked, vectors, ["c0"], search.Parameters(keyword_weight=0.0))


def test_rrf_points():
    points = evaluate.rrf_points()
    assert len(points) == 96 == len({tuple(p.values()) for p in points}) and points[0] == {"point": 0, "k": 10, "w0": 1.0, "w1": 1.0, "min_score": 0.0, "window": 100}


def test_knn_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(n, "ab"[n % 2], [rng.gauss(0, 1) for _ in range(8)]) for n in range(200)] + [(200, "a", None)]
    entries = spark.createDataFrame(rows, "id long, ctx string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(n, rows[n][2]) for n in range(3)], "query_id long, vector array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for r in vector.knn(entries, asked, 5, ("ctx",)).groupBy("query_id", "ctx").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).collect():
        best = sorted((i for i, c, v in rows if c == r.ctx and v), key=lambda i: -cos(rows[i][2], rows[r.query_id][2]))[:5]
        assert [x.id for x in r.x] == best


def test_knn_settles_ties_by_id(spark, monkeypatch):
    rows = [(n, "x", [1.0, 0.0] if n % 2 else [0.0, 1.0]) for n in range(1, 41)]
    df = spark.createDataFrame(rows, "id long, path string, embedding array<float>").repartition(1)
    asked = spark.createDataFrame([(n, [1.0, 0.0]) for n in range(5)], "query_id long, vector array<float>")
    monkeypatch.setattr(vector, "BLOCK", 2)
    found = vector.knn(df, asked, 3).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in found) == [(q, k + 1, i) for q in range(5) for k, i in enumerate((1, 3, 5))]
    assert vector.knn(df, asked.limit(0), 3).count() == 0 and vector.knn(df.limit(0), asked, 3).count() == 0


def test_cells_that_are_too_far_are_not_read(spark, folder, monkeypatch):
    """The same rows with and without cells, in several stripes; of tight clusters most cells are left out."""
    monkeypatch.setattr(vector, "STRIPE", 200)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(30)]
    rows = [(n, f"c{n % 2}", f"p{n % 7}", [x + rng.gauss(0, 0.03) for x in centres[n % 30]]) for n in range(900)] + [(900, "c0", "p", [0.0] * 6), (901, "c1", "p", None)]
    df = spark.createDataFrame(rows, "id long, ctx string, path string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(n, rows[n][3]) for n in range(20)] + [(99, [0.0] * 6)], "query_id long, vector array<float>")
    plain = vector.knn(df, asked, 9, ("ctx",), ("path", "id"))
    kept = vector.clustered(df, f"{folder}/cells")
    got = vector.knn(kept, asked, 9, ("ctx",), ("path", "id"))
    key = lambda d: sorted((r.query_id, r.ctx, r["rank"], r.id, round(r.similarity, 8)) for r in d.collect())
    assert key(got) == key(plain) and len(key(plain)) == 21 * 2 * 9
    n = vector.knn(kept, asked.filter("query_id < 99"), 9, ("ctx",), counted=True).first()
    assert n.cells_read < 0.7 * n.cells_met
    assert vector.clustered(df.limit(0), f"{folder}/none").count() == 0


def test_spearman_of_one_value(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("b", 5.0, 1.0)], "g string, x double, y double")
    assert {r.g: r.rho for r in evaluate.spearman(rows, "x", "y", "g").collect()} == {"a": pytest.approx(1.0), "b": None}


def test_grid():
    points = evaluate.grid()
    assert len(points) == 96 and len({tuple(p.values()) for p in points}) == 96 and [p["point"] for p in points] == list(range(96))


def test_one_arrow_pass_counts_as_unicode_patterns_would(spark):
    words = ["never", "naïve", "never—always", "does not need", "does not. need", "\u00a0always\u00a0", "must be", "12\u00a0ms", "ünever", "x" * 30]
    rng = random.Random(8)
    rows = [(n, "p1", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for n in range(60)] + [(60, "p2", None), (61, None, "P1 and p2 " + "x" * 300 + " p3")]
    df = spark.createDataFrame(rows, "id long, project_id string, value string")
    got = {r.id: r for r in promotion.measured(df, ["p1", "P2", "p3"]).collect()}
    for n, own, text in rows:
        text = text or ""
        assert got[n].n_rule == len(re.findall(promotion.RULE_LANGUAGE, text)) and got[n].units == len(re.findall(promotion.NUMBER_WITH_UNIT, text)) and got[n].n_spaced == len(text.split())
    assert (got[61].near, got[61].far, got[0].near) == (True, True, False)


def entries(spark, *rows):
    base = dict(path="p", hash="h", value="v", source_file=None, scope="project", project_id="a", context_label=None, workspace_id=None, embed_state="embedded", created_at=0, access_count=0, rating=0.2, ttl_days=None, chunk_index=0, total_chunks=0)
    schema = "id long, path string, hash string, value string, source_file string, scope string, project_id string, context_label string, workspace_id string, embed_state string, created_at long, access_count long, rating double, ttl_days double, chunk_index int, total_chunks int"
    return spark.createDataFrame([tuple({"id": n, **base, **r}.values()) for n, r in enumerate(rows)], schema)


def test_rating_and_sweep(spark):
    df = entries(spark, {"created_at": 0}, {"created_at": 30 * 86400, "access_count": 1})
    assert [r[0] for r in df.orderBy("id").select(tx.rating("created_at", "access_count", 30 * 86400)).collect()] == [pytest.approx(0.25), pytest.approx(0.55)]
    day = 86400
    df = entries(spark, {"ttl_days": 5.0, "hash": "1"}, {"ttl_days": 10.0, "hash": "2"}, {"ttl_days": 5.0, "rating": 0.3, "hash": "3"}, {"hash": "4"}, {"ttl_days": 1.0, "hash": "5"}, {"hash": "5", "scope": "shared"})
    assert [r.id for r in lifecycle.sweep(df, "a", 10 * day).collect()] == [0]


def test_buckets_and_numbering(spark):
    df = entries(spark, {}, {}, {"project_id": "b"}, {"scope": "shared"}, {"scope": "shared", "project_id": "b"}, {"scope": None, "workspace_id": "w"}, {"scope": None, "workspace_id": "w"}, {"hash": None}, {"hash": None})
    assert sorted(r.id for r in lifecycle.first_of_bucket(df).collect()) == [0, 2, 3, 5, 6, 7, 8]
    df = entries(spark, {"source_file": "f"}, {"source_file": "f", "project_id": "b"}, {"source_file": "f"}, {})
    assert {r.id: (r.chunk_index, r.total_chunks) for r in lifecycle.numbered(df).collect()} == {0: (0, 2), 1: (0, 1), 2: (1, 2), 3: (0, 0)}


def test_delete_and_share(spark):
    df = entries(spark, {"hash": "x", "source_file": "d/a"}, {"hash": "y", "source_file": "d"}, {"hash": "z", "source_file": "dx"}, {"hash": "w", "scope": None, "workspace_id": "w", "source_file": "d/a"})
    assert sorted(r.id for r in lifecycle.delete_subtree(df, "a", "d").collect()) == [2, 3]
    left, stones = lifecycle.delete_hash(df, "a", "x", 7)
    assert sorted(r.id for r in left.collect()) == [1, 2, 3] and [tuple(r) for r in stones.collect()] == [("x", "project", 7)]
    assert lifecycle.delete_hash(df, "a", "w", 7)[1].count() == 0
    df = df.withColumn("section", F.lit("s"))
    once = lifecycle.share(df, df.select("project_id", "hash"))
    assert {r.path for r in once.collect()} == {"shared/p"}
    assert lifecycle.share(df.unionByName(once.select(*df.columns)), df.select("project_id", "hash")).count() == 0


def test_sync_order(spark):
    local = entries(spark, {"hash": "both", "path": "1"}, {"hash": "mine", "path": "2"}).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    remote = entries(spark, {"hash": "both", "path": "1"}, {"hash": "mine", "path": "2"}, {"hash": "new", "path": "3"}, {"hash": "dead", "path": "4"}, {"hash": "ws", "scope": None, "workspace_id": "w"}).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    stone = lambda *rows: spark.createDataFrame(rows or [], "hash string, scope string, deleted_at long")
    rows, stones = sync.merge(local, remote, stone(("dead", "project", 5)), stone(("mine", "project", 9)), last_pull_at=6)
    assert {(r.hash, r.embed_state) for r in rows.collect()} == {("both", "pending"), ("new", "pending")}
    ids = [r.id for r in sync.merged(local, remote, stone()).collect()]  # both banks count from 0
    assert len(ids) == len(set(ids)) == 4 and {0, 1} < set(ids)
    assert [(r.hash, r.deleted_at) for r in stones.collect()] == [("mine", 9)]


def test_markdown_chunks():
    text = "a b\nc d\n```\nx y z\n\nq\n```\ne\n"
    assert chunk.markdown_chunks(text, 4, 0) == ["a b\nc d\n", "```\nx y z\n\nq\n```\n", "e\n"]
    assert "".join(chunk.markdown_chunks("one\r\ntwo\rthree", 1, 0)) == "one\ntwo\nthree"
    assert chunk.markdown_chunks("a\nb\nc\n", 2, 1) == ["a\nb\n", "b\nc\n"]
    assert chunk.markdown_chunks("~~~\nopen\nto the end", 2, 0) == ["~~~\nopen\nto the end"]
    assert chunk.markdown_chunks("", 2, 0) == []


def test_chunk_bounds():
    assert chunk.bounds() == (256, 48) and chunk.bounds(9000, 48, "openai") == (8191, 48) and chunk.bounds(10, 48) == (10, 9)
    with pytest.raises(ValueError):
        chunk.markdown_chunks("a", 4, 4)
    assert chunk.markdown_chunks("a\x0cb\u2028c\nd", 1, 0) == ["a\x0cb\u2028c\n", "d"]


def test_chunkers(spark):
    long = "word " * 300
    files = [
        ("a", "adr", f"# Use a cache\n{long}\n## Context\nc\n## Decision\nd"), ("b", "doc", "lead\n# One\nx\n## Two\ny\n### Three\nz"), ("c", "note", " whole \n## no split\n"), ("d", "skill", "---\nname: mend\n---\nintro\n## Steps\ns"),
        ("e", "remember", "## 2024-05-01 first\nx\n## undated\ny\n## 2024-06-01\nz"), ("f", "rules", "| rule | why |\n| --- | --- |\n| R1 | a |\n| R2 | b |"), ("g", "odd", "# H\nq"), ("h", "adr", "# T\nshort"),
    ]
    got = {}
    for r in chunk.by_kind(spark.createDataFrame(files, "path string, kind string, text string")).orderBy("path", "section_no").collect():
        got.setdefault(r.path, []).append((r.name, " ".join(r.body.split())[:40]))
    assert [n for n, _ in got["a"]] == ["preamble", "context", "decision"] and got["a"][1][1] == "Use a cache c" and got["h"] == [("whole", "# T short")]
    assert got["b"] == [("preamble", "lead"), ("One", "# One x"), ("Two", "## Two y ### Three z")] and got["c"] == [("whole", "whole ## no split")]
    assert got["d"] == [("preamble", "mend intro"), ("Steps", "mend s")] and [n for n, _ in got["e"]] == ["2024-05-01", "2024-06-01"]
    assert [b for _, b in got["f"]] == ["| R1 | a |", "| R2 | b |"] and got["g"] == [("H", "# H q")]


def test_ingest(spark):
    files = spark.createDataFrame([("f.md", "a b\nc d\na b\n"), ("g.md", "")], "path string, text string")
    bucket = {"scope": "project", "project_id": "a"}
    new = chunk.ingested(files, bucket, 7, 2, 0)
    none = new.withColumn("hash", F.lit("")).withColumn("embed_state", F.lit("")).limit(0)
    first = lifecycle.insert_chunks(none, new)
    assert sorted((r.path, r.value, r.chunk_index, r.embed_state) for r in first.collect()) == [("f.md", "a b\n", 0, "pending"), ("f.md", "c d\n", 1, "pending")]
    assert lifecycle.insert_chunks(first, new).count() == 0 and chunk.files_changed(first).first().n_files == 1


def test_snippets(spark):
    long = " ".join(f"word{n}" for n in range(200))
    values = ["short", long, "😀 " * 150, "x" * 500, None, "a" * 199 + " b c"]
    rows = spark.createDataFrame([(n, f"h{n}", v) for n, v in enumerate(values)], "id long, hash string, value string")
    for r in snippets.with_excerpt(rows).collect():
        text = r.value or ""
        assert r.snippet.strip("… ") in text and len(r.snippet) <= 204 and (len(text) > 200 or r.snippet == text)
    asked = spark.createDataFrame([(0, 1, long, ["word150", "word155", "word7"]), (1, 1, "a b", ["zz"])], "query_id long, id long, value string, terms array<string>")
    got = {r.query_id: r.snippet for r in snippets.with_best_window(asked).collect()}
    assert got == {0: "…" + " ".join(f"word{n}" for n in range(144, 156)) + "…", 1: "a b"}


def test_workspaces(spark):
    row = lifecycle.begin_workspace("a", "me", 1700000000123, (1 << 74) - 1)
    assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", row["id"]) and int(row["id"].replace("-", "")[:12], 16) == 1700000000123
    spaces = spark.createDataFrame([row, row | {"id": "w2", "status": "Closed", "closed_at": 5}], bank.TABLES["workspaces"])
    closed = {r.id: (r.status, r.closed_at) for r in lifecycle.close_workspace(lifecycle.close_workspace(spaces, row["id"], 9), "w2", 10).collect()}
    assert closed == {row["id"]: ("Closed", 9), "w2": ("Closed", 5)}
    asked = spark.createDataFrame([(1, row["id"], "a"), (2, "w2", "a"), (3, None, "a"), (4, row["id"], "b")], "request_id long, workspace_id string, project_id string")
    assert {r.request_id: r.refused for r in lifecycle.writable(asked, spaces).collect()} == {1: False, 2: True, 3: False, 4: True}
    left, after = lifecycle.discard_workspace(entries(spark, {"workspace_id": row["id"], "scope": None}, {}), spaces, "a", row["id"], 3)
    assert [r.id for r in left.collect()] == [1] and after.filter("status = 'Active'").count() == 0


def test_queue_discards_and_lookups(spark):
    queue = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), (None, "1")], "project_id string, hash string")
    left, gone = promotion.discarded(queue, "a", "1")
    assert (left.count(), gone.count()) == (3, 1) and promotion.discarded(queue, "a")[1].count() == 2
    df = entries(spark, {"hash": "x"}, {"hash": "x", "project_id": "b"})
    assert [r.id for r in lifecycle.lookup(df, "hash", "x", "b").collect()] == [1] and [r.id for r in lifecycle.lookup(df, "hash", "x").collect()] == [0]


def test_tolerant_values(spark):
    df = spark.createDataFrame([("7", "true", "[\"b\", \"a\"]"), (" 99 ", "TRUE", "{}"), ("x", "maybe", None), (None, None, "[1")], "n string, b string, j string")
    got = df.select(tx.parsed("n", "int", 4, 1, 16).alias("n"), tx.parsed("b", "boolean", False).alias("b"), tx.json_list("j").alias("j"), tx.one_of("b", ("True", "Maybe"), "None").alias("o")).collect()
    assert [tuple(r) for r in got] == [(7, True, ["b", "a"], "True"), (4, True, [], "True"), (4, False, [], "Maybe"), (4, False, [], "None")]
    one = spark.createDataFrame([("One two. Three! Four? Five.", "x\n## Head \ny", ["b", "a", "b"])], "t string, h string, l array<string>")
    assert tuple(one.select(tx.sentences("t", 16), tx.first_heading("h"), tx.scopes("l"), tx.as_json_list("l")).first()) == ("One two. Three!", "Head", ["a", "b"], '["b","a","b"]')


@pytest.mark.parametrize("seed", range(6))
def test_eviction_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    counts = {f"p{n}": rng.randint(1, 9) for n in range(rng.randint(1, 6))}
    total = rng.randint(0, sum(counts.values()) + 2)
    want = dict(counts)
    while sum(want.values()) > total:
        most = max(want.values())
        want[min(k for k, v in want.items() if v == most)] -= 1
    got = promotion.kept_counts(spark.createDataFrame(list(counts.items()), "project_id string, used long"), total).collect()
    assert {r.project_id: r.kept for r in got} == want


def test_capacity(spark):
    queue = spark.createDataFrame([(f"p{n % 5}",) for n in range(12)], "project_id string")
    assert {r.reserved for r in promotion.capacity(queue, 1000).collect()} == {200}
    assert {r.reserved for r in promotion.capacity(queue, 3).collect()} == {0}


def test_retry_states(spark):
    rng = random.Random(5)
    rows = [(p, "w", n, rng.random() < 0.3) for p in "abcd" for n in range(30)]
    want = {}
    for p in "abcd":
        failures, status = 0, ""
        for q, _, n, ok in rows:
            if q == p:
                failures, status = ev.after_result(failures, ok, status == "Stopped")
                want[p, n] = (failures, status)
    got = ev.retry_states(spark.createDataFrame(rows, "project_id string, watch_path string, seq long, ok boolean")).collect()
    assert {(r.project_id, r.seq): (r.failures, r.status) for r in got} == want


def test_streams(spark, folder):
    rows = [("p", "w", n, n % 4 == 0) for n in range(12)]
    spark.createDataFrame(rows, "project_id string, watch_path string, seq long, ok boolean").coalesce(1).write.parquet(f"{folder}/in")
    stream = ev.stream_retry_states(spark.readStream.schema("project_id string, watch_path string, seq long, ok boolean").parquet(f"{folder}/in"))
    q = stream.writeStream.format("memory").queryName("retries").outputMode("append").option("checkpointLocation", f"{folder}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.seq, r.failures, r.status) for r in spark.table("retries").collect()) == sorted((r.seq, r.failures, r.status) for r in ev.retry_states(spark.createDataFrame(rows, "project_id string, watch_path string, seq long, ok boolean")).collect())
    spark.createDataFrame([("p", "a", 1, "Created"), ("p", "a", 2, "Deleted"), ("p", "b", 3, "Created")], "project_id string, path string, seq long, kind string").coalesce(1).write.parquet(f"{folder}/ev")
    seen = []
    q = ev.run_mirror(spark.readStream.schema("project_id string, path string, seq long, kind string").parquet(f"{folder}/ev"), lambda df, n: seen.extend((r.path, r.kind) for r in df.collect()), f"{folder}/c2", "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a", "Deleted"), ("b", "Created")]


def test_bank(spark, folder):
    assert bank.load(spark, folder, "entries").count() == 0
    old = spark.createDataFrame([("h", "shared", 1)], "hash string, scope string, deleted_at long")
    bank.save(old, folder, "tombstones")
    again = bank.load(spark, folder, "tombstones")
    bank.save(again.unionByName(old.withColumn("hash", F.lit("g"))), folder, "tombstones")  # reads what it replaces
    assert {r.hash for r in bank.load(spark, folder, "tombstones").collect()} == {"h", "g"}
    spark.createDataFrame([(1, "project")], "id long, scope string").write.parquet(f"{folder}/entries")
    row = bank.load(spark, folder, "entries").first()
    assert (row.access_count, row.rating, row.embed_state, row.value) == (0, 0.5, "pending", None)
    assert bank.attached(spark, folder, "entries")["entries"].count() == 1
    spark.createDataFrame([(1, "odd")], "id long, scope string").write.mode("overwrite").parquet(f"{folder}/entries")
    with pytest.raises(ValueError):
        bank.attached(spark, folder, "entries")
    tries = []
    sync.push(lambda: tries.append(1) if len(tries) else (tries.append(0), (_ for _ in ()).throw(KeyError()))[1], KeyError)
    assert tries == [0, 1]


def test_a_kept_table_follows_its_source(spark, folder):
    made = []

    def index():
        made.append(1)
        return spark.read.parquet(f"{folder}/t").groupBy("x").count()

    spark.createDataFrame([(1,), (1,)], "x int").write.parquet(f"{folder}/t")
    assert [tuple(r) for r in tables.maintained("t", spark.read.parquet(f"{folder}/t"), index).collect()] == [(1, 2)]
    tables.maintained("t", spark.read.parquet(f"{folder}/t"), index)
    assert made == [1]
    spark.createDataFrame([(2,)], "x int").write.mode("append").parquet(f"{folder}/t")
    assert tables.maintained("t", spark.read.parquet(f"{folder}/t"), index).count() == 2 and made == [1, 1]


def test_files(spark, folder):
    os.makedirs(f"{folder}/sub")
    for name in ("a.md", ".hidden.md", "b.py", "sub/c.TXT"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("# T\nx\n")
    found = files.listing(spark, folder)
    assert {r.path.removeprefix(folder) for r in found.collect()} == {"/a.md", "/sub/c.TXT"}
    assert {r.path.removeprefix(folder): r.text for r in files.read_files(spark, folder).collect()} == {"/a.md": "# T\nx\n", "/sub/c.TXT": "# T\nx\n"}
    known = found.limit(1).select("path")
    assert files.due(found, known, None).count() == 2 and files.due(found, known, 1 << 40).count() == 1
    assert files.in_scope(f"{folder}/sub/c.TXT", [folder]) and not files.in_scope("/etc", [folder]) and not files.in_scope(folder, [])


def test_whole_passages_in_texts(spark):
    """All passages against all texts, short ones too: their words may be cut in a text, so that of five words only three are sure to stand in it. While passages are few no words are shuffled."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", " ", "a  b  c  d  e  f  g", "xb c d efg h"]
    passages = [(n, t[rng.randint(0, 5) :][: rng.randint(1, 30)]) for n, t in enumerate(texts[:60])] + [(100, None), (101, "b c d e f"), (102, "b c d e"), (103, "  b  c  d "), (104, "c d ef"), (105, ""), (None, "b c d efg h"), (106, "b c")]
    docs = spark.createDataFrame([*enumerate(texts), (None, "xb c d efg h")], "id long, text string").repartition(3)
    items = spark.createDataFrame(passages, "query_id long, passage string")
    want = {(q, i) for q, p in passages for i, t in [*enumerate(texts), (None, "xb c d efg h")] if p is not None and t is not None and p in t}
    for most in (evaluate.BROADCAST_PASSAGES, 0):
        got = list(map(tuple, evaluate.holding(docs, items, most).collect()))
        assert len(got) == len(set(got)) and set(got) == want
    assert "hashpartitioning(key" not in evaluate.holding(docs, items)._jdf.queryExecution().executedPlan().toString()
