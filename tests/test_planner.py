"""Plans of search texts, contexts and windows; expected values written by hand."""

import pytest

from lorekeep.plans import planner as p


@pytest.mark.parametrize(
    ("text", "plan"),
    [
        ("what is the", p.Plan()),
        ("Kubernetes", p.Plan(every=("kubernetes",), n_tokens=1)),
        ("and or not near", p.Plan()),
        ("cache and index", p.Plan(every=("cache", "index"), fallback=("cache", "index"), n_tokens=2)),
        ("how does the button style work", p.Plan(every=("button", "style", "work"), fallback=("how", "does", "the", "button", "style", "work", "button style", "style work"), n_tokens=3)),
        ("one two three four five the", p.Plan(some=("one", "two", "three", "four", "five", "the"), n_tokens=5)),
        ("x_1, Y-2!", p.Plan(every=("x_1", "y", "2"), fallback=("x_1", "y", "2", "x_1 y", "y 2"), n_tokens=3)),
    ],
)
def test_plans(text, plan):
    assert p.build(text) == plan


def test_plans_of_a_table(spark):
    texts = ["what is the", "Kubernetes", "and or not near", "cache and index", "how does the button style work", "one two three four five the", "", "docs/Guide.md", " docs/a.md#getting-started ", "docs/a.md#ß-three-words", "see docs/a.md now", "A.TXT#x", None]
    for r in p.planned(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")).collect():
        text = texts[r.query_id] or ""
        plan = p.path_plan(text) or p.build(text)
        assert (tuple(r.every), tuple(r.some), tuple(r.fallback), r.n_content) == (plan.every, plan.some, plan.fallback, plan.n_tokens), text
        assert bool(r.is_path) == (p.path_plan(text) is not None) and bool(r.has_section) == (plan.columns == ("source_file", "section"))


def test_access():
    assert p.allowed("ro", None, "read") and not p.allowed("ro", "full", "write") and p.allowed(None, "full", "destructive") and not p.allowed(None, None, "destructive") and p.allowed("odd", None, "write")


def test_paths():
    assert p.path_plan("docs/Guide.md").every == ("docs", "guide", "md")
    assert p.path_plan("docs/a.md#getting-started").every == ("docs", "a", "md", "getting started")
    assert p.path_plan("docs/a.md#getting-started-guide-for-all").every == ("docs", "a", "md", "getting started guide for all")
    assert p.path_plan("docs/a.md#x").columns == ("source_file", "section")
    assert p.path_plan("a sentence about a.md files") is None
    assert p.path_plan("script.py") is None


@pytest.mark.parametrize(("limit", "wide", "narrow"), [(1, 100, 50), (10, 100, 50), (20, 100, 100), (40, 120, 200), (100, 300, 500)])
def test_windows(limit, wide, narrow):
    assert (p.window(limit), p.window(limit, True)) == (wide, narrow)


def test_contexts():
    assert p.contexts("all", "acme", "x", "w") == ["shared", "project:acme", "label:acme:x", "workspace:w"]
    assert p.contexts("project", "acme") == ["project:acme"]
    assert p.contexts("shared", "acme", None, "w") == ["shared"]
    assert p.context_key_for("workspace:ws-1", "acme") == "workspace:4:acme:ws-1"
    assert p.context_key_for("docs-notes", "acme") == "custom:4:acme:docs-notes"
    assert p.context_key_for("project:other", "acme") == "project:other"
    assert p.context_key_for("label:a:b:c", "a") == "custom:1:a:b:c"
    assert p.context_key_for("label:b:c", "a:b") != p.context_key_for("label:b:c", "a")
    assert p.write_context(" ", "w", "p") == "workspace:w"
    assert p.bucket("label:p:x", "p")["context_label"] == "x"
