"""Ingest rules, trees, snippets, workspaces and loops against second implementations."""

import json
import os
import random
import re
import time

from pyspark.sql import functions as F

from lorekeep.operators import chunk, lifecycle, promotion, snippets
from lorekeep.sources import bank, files
from lorekeep.streaming import events as ev


def test_scopes_are_held_against_in_tasks(spark, folder):
    os.makedirs(f"{folder}/in/deep")
    os.makedirs(f"{folder}/in-other")
    os.makedirs(f"{folder}/out")
    for name in ("in/a.md", "in/deep/b.TXT", "in/c.py", "in-other/d.md", "out/e.md"):
        with open(f"{folder}/{name}", "w") as file:
            file.write(name)
    os.symlink(f"{folder}/out/e.md", f"{folder}/in/link.md")
    paths = [f"{folder}/{x}" for x in ("in/a.md", "in/deep/b.TXT", "in/c.py", "in-other/d.md", "out/e.md", "out/f.py", "in/link.md", "in/../out/e.md", "in/none.md")]
    df = spark.createDataFrame([(p, "t") for p in paths], "path string, text string").repartition(3)
    scopes = [f"{folder}/in", f"{folder}/in/deep/", f"{folder}/nowhere"]
    got = {r.path.removeprefix(f"{folder}/"): r.verdict for r in files.verdicts(df, scopes).collect()}
    assert got == {"in/a.md": "ok", "in/deep/b.TXT": "ok", "in/c.py": "unsupported", "in-other/d.md": "outside", "out/e.md": "outside", "out/f.py": "outside", "in/link.md": "outside", "in/../out/e.md": "outside", "in/none.md": "ok"}
    assert [r.path for r in files.ingestable(df, scopes).collect()] == sorted(f"{folder}/in/{x}" for x in ("a.md", "deep/b.TXT", "none.md")) and files.ingestable(df, []).count() == 0
    inserted = spark.createDataFrame([(f"{folder}/in/a.md",), (f"{folder}/in/a.md",), (f"{folder}/in/c.py",)], "source_file string")
    n = {r.path.removeprefix(f"{folder}/"): r.n for r in files.ingest_results(df, scopes, inserted).collect()}
    assert {k for k, v in n.items() if v} == {"in/a.md"} and len(n) == len(paths)
    rng = random.Random(1)
    for _ in range(200):
        pick = lambda: "/" + "/".join(rng.choice(["a", "b", "a-b", "ab"]) for _ in range(rng.randint(1, 4)))
        tops, path = [pick() for _ in range(rng.randint(0, 4))], pick()
        assert files.in_scope(path, tops) == any(path == t or path.startswith(t + "/") for t in tops)


def test_nested_tree(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(3)}", "/".join(rng.choice(["a", "b", "é\"x", "z z", "B"]) for _ in range(rng.randint(1, 5)))) for _ in range(120)] + [("q", "one"), ("q", "one/two")]
    want = {}
    for project, path in rows:
        at = want.setdefault(project, {})
        for part in path.split("/"):
            at = at.setdefault(part, {})
    got = {r.project_id: r.tree for r in files.tree_json(spark.createDataFrame(rows, "project_id string, path string")).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == want
    order = lambda x: {k: order(x[k]) for k in sorted(x, key=str.encode)}
    assert got == {k: json.dumps(order(v), separators=(",", ":"), ensure_ascii=False) for k, v in want.items()}
    assert files.tree_json(spark.createDataFrame([], "project_id string, path string")).count() == 0


def brute_window(words, terms, size):
    token = lambda w: re.findall(r"[^\W_]+", w.lower())
    best = (0, 0)
    for start in range(max(0, len(words) - size) + 1):
        flat = [t for w in words[start : start + size] for t in token(w)]
        n = sum(any(flat[i : i + len(t.split(" "))] == t.split(" ") for i in range(len(flat))) for t in terms)
        best = max(best, (n, -start))
    return -best[1]


def test_best_window(spark):
    rng = random.Random(3)
    rows = []
    for n in range(150):
        words = [rng.choice(["alpha", "beta", "gamma-delta", "x", "y", "Zeta,", "(eta)"]) for _ in range(rng.randint(1, 60))]
        rows.append((1, n, " ".join(words), rng.sample(["alpha", "beta", "gamma", "delta beta", "zeta eta", "eta", "alpha beta x"], rng.randint(1, 4))))
    df = spark.createDataFrame([*rows, (1, 900, None, ["alpha"]), (1, 901, "  one  two ", ["two"])], "query_id long, id long, value string, terms array<string>").repartition(3)
    got = {r.id: r.snippet for r in snippets.with_best_window(df, size=5).collect()}
    for _, n, text, terms in rows:
        words = text.split()
        start = brute_window(words, terms, 5)
        assert got[n] == ("…" if start else "") + " ".join(words[start : start + 5]) + ("…" if start + 5 < len(words) else ""), (text, terms)
    assert got[900] == "" and got[901] == "one two"


def test_projects_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    names = [f"proj{k}" for k in range(40)]
    rows = [(n, rng.choice(names), " ".join(rng.choice([*names, "word", "x" * 50]) for _ in range(rng.randint(0, 12)))) for n in range(80)]
    df = spark.createDataFrame(rows, "id long, project_id string, value string")
    flags = lambda: sorted((r.id, r.near, r.far) for r in promotion.measured(df, names).collect())
    want = flags()
    monkeypatch.setattr(promotion, "PROJECTS_AT_ONCE", 7)
    assert flags() == want and len({x[1:] for x in want}) > 2


def test_a_snapshot_takes_no_workspaces_and_no_settings(spark):
    df = spark.createDataFrame([(1, None), (2, "w")], "id long, workspace_id string")
    rows, settings = bank.pushed(df, spark.createDataFrame([("k", "v")], "key string, value string"))
    assert [r.id for r in rows.collect()] == [1] and settings.count() == 0 and settings.columns == ["key", "value"]


def test_embedding_of_pending_rows(spark):
    df = spark.createDataFrame([(1, "one", None, "pending"), (2, "three", [9.0], "embedded"), (3, None, None, "pending")], "id long, value string, embedding array<float>, embed_state string").repartition(2)
    done = lifecycle.embed(df, lambda texts: [[float(len(t or ""))] for t in texts])
    assert sorted((r.id, r.embedding, r.embed_state) for r in done.collect()) == [(1, [3.0], "embedded"), (2, [9.0], "embedded"), (3, [0.0], "embedded")]
    assert lifecycle.reembedded(df, "a|b|1", "a|b|1").filter("embed_state = 'pending'").count() == 2 and lifecycle.reembedded(df, "a|b|1", "a|b|2").filter("embedding IS NULL").count() == 3


def test_consolidation_of_listed_entries(spark):
    schema = "id long, path string, hash string, value string, source_file string, section string, scope string, project_id string, context_label string, workspace_id string, embed_state string, embedding array<float>, chunk_index int, total_chunks int, created_at long, access_count long, rating double, ttl_days double"
    row = lambda n, path, scope, ws: (n, path, f"h{path}", f"v{path}", None, None, scope, "a", None, ws, "pending", None, 0, 0, 0, 0, 0.5, None)
    df = spark.createDataFrame([row(1, "x", None, "w"), row(2, "y", None, "w"), row(3, "z", None, "w"), row(4, "z", "project", None), row(5, "x", None, "v")], schema)
    promoted, discarded = lifecycle.consolidate_workspace(df, "a", "w", ["hx", "hz"])
    assert {r.path for r in promoted.collect()} == {"x"} and {r.id for r in discarded.collect()} == {1, 2, 3}
    promoted, discarded = lifecycle.consolidate_workspace(df, "a", "w", [])
    assert promoted.count() == 0 and discarded.count() == 3


def test_one_project_s_failure_is_its_own():
    seen = []

    def step(project):
        seen.append(project)
        if project == "b":
            raise ValueError("no")

    assert ev.each_project(["a", "b", "c"], step) == {"a": None, "b": "ValueError: no", "c": None} and seen == ["a", "b", "c"]


def test_the_extraction_loop_runs_for_the_projects_of_the_time(spark, folder):
    told, projects = [], ["a"]
    q = ev.run_extraction(spark, lambda: list(projects), lambda p: None, told.append, f"{folder}/c", "0 seconds")
    try:
        end = time.time() + 60
        while len(told) < 2 and time.time() < end:
            projects[:] = ["a", "b"]
            time.sleep(0.2)
    finally:
        q.stop()
    assert told and told[-1] in ({"a": None}, {"a": None, "b": None}) and told[-1].keys() <= {"a", "b"}


def test_chunks_of_a_table_are_those_of_each_text(spark):
    rng = random.Random(6)
    parts = ["word word word", "# Heading", "```", "~~~", "x y z", "", "a " * 30, "## H2", "| a | b |"]
    rows = [(f"f{n}.md", "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for n in range(40)] + [("n.md", None), ("e.md", "")]
    got = chunk.chunked(spark.createDataFrame(rows, "path string, text string").repartition(3), 20, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append((r.chunk_index, r.total_chunks, r.chunk))
    for path, text in rows:
        chunks = chunk.markdown_chunks(text or "", 20, 5)
        assert sorted(by.get(path, [])) == [(k, len(chunks), x) for k, x in enumerate(chunks)]
        plain = chunk.markdown_chunks(text or "", 20, 0)
        assert re.sub(r"\s", "", "".join(plain)) == re.sub(r"\s", "", text or ""), path  # without overlap nothing is lost or doubled
        assert all(chunk.count_words(x) <= 20 or "```" in x or "~~~" in x or sum(map(bool, map(str.strip, x.splitlines()))) == 1 for x in plain)
