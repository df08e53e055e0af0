"""Promotion scoring: where an entry comes from, what its text looks like, and the candidate queue."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import basename, content_hash, preview, stripped

# Base scores of the archetypes.
PRIORS = {
    "organic-note": 3.45,
    "adr": 3.00,
    "charter": 2.45,
    "explanation": 2.30,
    "measurement": 2.10,
    "research-synthesis": 1.90,
    "reference": 1.45,
    "work-note": 1.15,
    "catalog-page": 1.10,
    "changelog-entry": 1.05,
    "plan": 0.85,
    "review": 0.80,
    "doc-index": 0.25,
    "turn-mirror": 0.45,
}

# Patterns of the text features.
WORD = r"[A-Za-z][A-Za-z0-9_\-']*"
TURN_MARKUP = r"(?i)</?(invoke|parameter|content|sourceFile|antml:invoke|function_calls)\b|<invoke\s+name=|<parameter\s+name="
RULE_LANGUAGE = r"(?i)\bnever\b|\balways\b|\bmust (?:still |be |not |name|make|raise)|\bdo not\b|\bdon't\b|\bdoes not\b(?=[^.]{0,40}\b(?:index|need|cover|apply))|\bprefer\b|\binvariant\b|\btraps?\b|\bgotchas?\b|\bbeware\b|\bmitigations?\b|\bworkarounds?\b|\brule\b|\bcontract\b|\bfuture (?:session|audit|reader|maintainer)|\bbefore proposing\b|\bnot (?:evidence|drift|duplication|debt)\b|\bis correct output\b|\bread (?:that|this|it) (?:comment |note )?before\b|\brecorded here\b|\bso nobody\b|\bexempt\b|\bby design\b|\bdeliberate(?:ly)?\b|\bon purpose\b|\brequired\b|\bsilently\b|\bfails? open\b|\bworse than\b"
MEASURE_WORDS = r"(?i)\bmeasured\b|\bbest-of-\d|\bwall (?:clock|time)\b|\bbenchmark(?:ed|dotnet)?\b|\bobserved\b|\breproduc(?:ed|ible)\b|\bverified independently\b|\bp9[59]\b|\bthroughput\b|\bpeak rss\b|\bpassed?\b\s*\d|\bnDCG\b|\brecall@|\bMRR\b"
NUMBER_WITH_UNIT = r"(?i)\b\d+(?:[.,]\d+)?\s?(?:ms|s|sec|secs|seconds|m|min|mb|gb|kb|%|×|x|tokens?)\b|\b\d+(?:[.,]\d+)?\s?(?:tests?|chunks?|packages?|lines?|files?|commits?)\b"
EPHEMERA = r"(?i)\bAC:|\bGate(?:s)?:|\bacceptance criteria\b|\beffort:|\bimpact:|\bevidence:\s*(?:MEASURED|INFERRED)|\bworktree\b|\bwave \d|\bsub-?agents?:|\bpersona\s*/\s*model|\bcloses:|\bdispatch(?:ed|ing)?\b|\bTDD: (?:yes|no)\b|\bowner (?:ruling|action|requirement)\b|\brisk if deferred\b|\breviewer lane\b|\blens (?:a\d|of)\b|\bthis lens\b|\bread-only (?:review|audit)\b|\bout of scope for\b|\bfollow-?ups? §|\bstatus:\s*(?:executed|open|verified)\b|\bPR #\d+|\bissue #\d+|\bPRs? #\d+|\b#\d{3,}\b"
SUPERSEDED = r"(?i)\bsupersed(?:ed|es|ing)\b|\bhistorical note\b|\bno longer\b|\bwas (?:reversed|retracted)\b|\bhistorical\)|\bthis was resolved\b|\bhas now (?:fired|lapsed)\b|\bpreviously lived\b"
FINDING_ROW = r"(?m)^\s*\|\s*\**\s*[A-Z]{1,3}[-]?\d{1,3}\b"
LINK = r"\]\("
DOC_NAME = r"[\w.\-/]+\.md\b"
FRONTMATTER = r"(?m)^---\s*\nupdated:"
VERSION_ROW = r"(?m)^\s*\|\s*\d+\.\d+"
STATUS_OPENER = r"(?i)^\s*(Done\b|Fixed\b|Verified\b|Merged\b|Pinned\b|Recorded\b|Rendered\b|All confirmed|Status\b|Prep done|Shell ready|Task closed|Cleanup complete|Amended\b|Locked in|Draft PR|Fresh verification|No code has changed|f: |Implementation in flight|Extension complete|Rollout complete|Both\b|Ad-hoc verification|Render(?:\s|ing)|Plan written|Software MoE|From\b|Here.s the current|PR[- #]|\*\*1\.)"
STATUS_WORDS = r"(?i)\b(merged|pushed|re-pushed|in flight|worktree|pre-push|gate chain|full suite|suite green|passed\b|skipped\b|exit 0|handed over|dispatched|still working|waiting on|re-run|rebased|cherry-pick|draft PR|ready for review|cron job|status board|deliverable|committed as|origin/main|HEAD|CI checks)\b"
SECOND_PERSON = r"(?i)\b(your|you'll|you can|as instructed|per your)\b"
COMMIT = r"(?i)\b[0-9a-f]{7,10}\b"
TEST_COUNTS = r"(?i)\b\d+\s*(passed|failed|skipped|errors|warnings|green|assertions?)\b|\bexit 0\b|\b\d+/\d+\b"
MEASURE = r"\d+(?:\.\d+)?\s*(?:s|ms|x|%|lines?|KB|MB|GB|tokens?)\b"
DURABLE = r"(?i)\[facts\]|\bREGRESSION\b|\bgotcha\b|\broot cause\b|\brequires?\b|\bmust\b|\bnever\b|\balways\b|\bconvention\b|\bone \w+ per \w+|\bholds\b|\bby design\b|\bcontract\b|\bprecedence\b|\bsemantics\b"
DATED_FACT = r"\(\d{4}-\d{2}-\d{2}\)[:,]"

FLOOR, CANDIDATES = 0.4, 20


#: The look-ahead of RULE_LANGUAGE, which RE2 lacks: texts with this phrase are counted by Python.
_AHEAD, _AHEAD_PHRASE = r"(?=[^.]{0,40}\b(?:index|need|cover|apply))", "(?i)does not"
_LETTER = re.compile(r"[^\W\d\x00-\x7f]")
_DIGIT = re.compile(r"[^\D\x00-\x7f]")
_BLANK = re.compile(r"[^\S\x00-\x7f]")
#: Most project ids that are sent to every task.
PROJECTS_AT_ONCE = 200_000


def _plain(texts: pa.Array) -> pa.Array:
    """Texts with every letter, digit and space beyond ASCII replaced by one of its kind, so that ASCII classes and borders see what Unicode ones would."""
    odd = pc.invert(pc.string_is_ascii(texts))
    if not pc.any(odd).as_py():
        return texts
    changed = [_BLANK.sub(" ", _DIGIT.sub("0", _LETTER.sub("q", t))) for t in texts.filter(odd).to_pylist()]
    return pc.replace_with_mask(texts, odd, pa.array(changed, texts.type))


def _rule_counts(plain: pa.Array) -> pa.Array:
    found = pc.count_substring_regex(plain, RULE_LANGUAGE.replace(r"|\bdoes not\b" + _AHEAD, ""))
    odd = pc.match_substring_regex(plain, _AHEAD_PHRASE)
    if not pc.any(odd).as_py():
        return found
    whole = re.compile(RULE_LANGUAGE)
    return pc.replace_with_mask(found, odd, pa.array([len(whole.findall(t)) for t in plain.filter(odd).to_pylist()], found.type))


#: Counts of patterns in a text, and whether it has others.
_COUNTED = {
    "n_markup": TURN_MARKUP, "words_m": MEASURE_WORDS, "units": NUMBER_WITH_UNIT, "n_links": LINK, "n_names": DOC_NAME, "n_versions": VERSION_ROW, "n_findings": FINDING_ROW, "n_ephemera": EPHEMERA, "n_status": STATUS_WORDS,
    "n_durable": DURABLE, "n_commits": COMMIT, "n_spaced": r"\S+", "n_lines": r"(?m)^[^\n]*\S[^\n]*$", "n_rows": r"(?m)^[^\S\n]*\|",
}
_HELD = {"past": SUPERSEDED, "second_person": SECOND_PERSON}
FEATURES = ("n_words", "n_rule", *_COUNTED, "n_measures")
FLAGS = (*_HELD, "heading", "middle", "front", "opener", "dated", "near", "far")


def _automaton(names: list[str]):
    """What finds these names in a text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def measured(rows: DataFrame, project_ids: list[str] = []) -> DataFrame:
    """rows (with value and project_id) and the FEATURES and FLAGS of their texts, all found in one pass over Arrow columns; patterns run in RE2.

    Project ids are sent once to each executor and looked for in blocks of PROJECTS_AT_ONCE, so that one automaton of that size is held at a time.
    """
    names = sorted({p.lower() for p in project_ids})
    sent = rows.sparkSession.sparkContext.broadcast([names[k : k + PROJECTS_AT_ONCE] for k in range(0, len(names), PROJECTS_AT_ONCE)])
    kinds, columns = rows.dtypes, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _automaton(sent.value[0]) if len(sent.value) == 1 else None
        for batch in batches:
            if not batch.num_rows:
                continue
            value = pc.fill_null(batch.column("value").cast(pa.string()), "")
            plain = _plain(value)
            trimmed = pc.utf8_ltrim_whitespace(value)
            found = {"n_words": pc.count_substring_regex(value, WORD), "n_rule": _rule_counts(plain)}
            found |= {name: pc.count_substring_regex(plain, pattern) for name, pattern in _COUNTED.items()}
            found["n_measures"] = pc.count_substring_regex(pc.replace_substring_regex(plain, TEST_COUNTS, " "), MEASURE)
            held = {name: pc.match_substring_regex(plain, pattern) for name, pattern in _HELD.items()}
            held |= {"heading": pc.starts_with(trimmed, "#"), "middle": pc.match_substring_regex(trimmed, r"^[\p{Ll}),;]"), "front": pc.match_substring_regex(trimmed, FRONTMATTER)}
            held |= {"opener": pc.match_substring_regex(pc.utf8_slice_codeunits(plain, 0, 80), STATUS_OPENER), "dated": pc.match_substring_regex(pc.utf8_slice_codeunits(plain, 0, 120), DATED_FACT)}
            near, met = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            texts, owners = [x.lower() for x in value.to_pylist()], [(x or "").lower() for x in batch.column("project_id").to_pylist()]
            for block in sent.value:
                others = one or _automaton(block)
                for k, (text, own) in enumerate(zip(texts, owners)):
                    ends: dict[str, int] = {}
                    for end, name in others.iter(text):
                        if name != own:
                            ends.setdefault(name, end)
                    near[k] |= any(end < 250 for end in ends.values())
                    met[k] += len(ends)
            far = met >= 2
            held |= {"near": pa.array(near, pa.bool_()), "far": pa.array(far, pa.bool_())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(found[c].cast(pa.int32()) for c in FEATURES), *(held[c] for c in FLAGS)], [*columns, *FEATURES, *FLAGS])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in kinds), *(f"{c} int" for c in FEATURES), *(f"{c} boolean" for c in FLAGS)]))


def _per100(count: Column) -> Column:
    return 100.0 * count / F.greatest(F.col("n_words"), F.lit(1))


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def archetype(n_markup: Column | None = None) -> Column:
    """The class of an entry by path, file and markup (the number of TURN_MARKUP's matches in value); the first rule that holds decides."""
    n_markup = F.regexp_count("value", F.lit("(?U)" + TURN_MARKUP)) if n_markup is None else n_markup
    path = F.lower(F.coalesce("path", F.lit("")))
    name = basename(path)
    inside = lambda *parts: reduce(lambda a, b: a | b, (path.contains(p) for p in parts))
    named = lambda *parts: reduce(lambda a, b: a | b, (name.contains(p) for p in parts))
    rules = [
        ("turn-mirror", n_markup >= 2),
        ("organic-note", (F.coalesce("source_file", F.lit("")) == "") | name.rlike(r"(?i)^[0-9a-f]{32,}\.md$")),
        ("doc-index", name.isin("readme.md", "changelog.md", "index.md")),
        ("adr", inside("/adr/", "/decisions/") | name.rlike(r"^\d{4}-") & ~name.rlike(r"^\d{4}-\d{2}-\d{2}")),
        ("charter", named("charter")),
        ("explanation", inside("/explanation/", "/design/") | named("architecture")),
        ("plan", inside("/plans/") | name.startswith("plan") | named("-plan") | name.endswith("plan.md")),
        ("review", inside("/reviews/") | named("review", "moe-", "findings", "incident") | name.rlike(r"^[a-z]\d+-")),
        ("measurement", named("sweep", "benchmark", "-perf", "perf-")),
        ("research-synthesis", inside("/archive/") | named("research", "synthesis", "report")),
        ("reference", inside("/reference/", "/how-to/", "/tutorial/")),
        ("catalog-page", inside("/guide") | name.isin("skills.md", "getting-started.md", "glossary.md")),
        ("changelog-entry", inside("/changelog/", "/releases/")),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for tag, holds in rules[1:]:
        out = out.when(holds, tag)
    return out.otherwise("work-note")


def scored(rows: DataFrame, project_ids: list[str]) -> DataFrame:
    """Rows (path, source_file, value, project_id, access_count) with archetype, score (0 to 4) and reasons: one pass over the texts, then arithmetic."""
    columns = rows.columns
    rows = measured(rows, project_ids).withColumn("archetype", archetype(F.col("n_markup")))
    rows = rows.withColumns({
        "rule": _clamp(0.30 * _per100(F.col("n_rule")), 0.0, 0.75), "ephemera": _clamp(0.22 * _per100(F.col("n_ephemera")), 0.0, 0.65),
        "tables": F.col("n_rows") / F.greatest(F.col("n_lines"), F.lit(1)), "links": _per100(F.col("n_links")), "names": _per100(F.col("n_names")),
    })
    many = F.when((F.col("words_m") >= 1) & (F.col("units") >= 1), _clamp(0.12 * F.least("words_m", F.lit(4)) + 0.05 * F.least("units", F.lit(4)), 0.0, 0.50)).when(F.col("words_m") >= 2, 0.15).otherwise(0.0)
    pointer = _clamp(F.when(F.col("tables") >= 0.55, 0.30).otherwise(0.0) + F.when(F.col("links") >= 1.5, 0.45).otherwise(0.0) + F.when(F.col("names") >= 2.0, 0.35).otherwise(0.0) + F.when(F.col("n_versions") >= 3, 0.35).otherwise(0.0), 0.0, 1.0)
    rows = rows.withColumns({"many": many, "pointer": pointer})
    accessed = F.when(F.col("access_count") > 0, _clamp(0.05 * F.log(F.col("access_count") + 1.0), 0.0, 0.20)).otherwise(0.0)
    short, thin = F.length("value") < 420, F.col("n_words") < 60
    parts = [
        F.col("rule"), F.col("many"), F.when(F.col("near"), 0.25).otherwise(0.0), F.when(F.col("far"), 0.10).otherwise(0.0), F.when(F.col("heading"), 0.12).otherwise(0.0), F.when(F.col("middle"), -0.18).otherwise(0.0),
        accessed, -F.col("pointer"), F.when(F.col("n_findings") >= 3, -0.45).when(F.col("n_findings") >= 1, -0.28).otherwise(0.0), -F.col("ephemera"), F.when(F.col("past"), -0.40).otherwise(0.0),
        F.when(F.col("front") & (F.length("value") < 900), -0.55).when(F.col("front"), -0.25).otherwise(0.0), F.when(short, -0.35).otherwise(0.0), F.when(thin, -0.25).otherwise(0.0),
    ]
    adjusted = F.greatest(F.lit(-1.60), F.least(F.when(F.col("archetype").isin("doc-index", "turn-mirror"), 0.15).otherwise(1.30), reduce(lambda a, b: a + b, parts)))
    prior = F.create_map(*(F.lit(x) for pair in PRIORS.items() for x in pair))[F.col("archetype")]
    rows = rows.withColumn("raw", prior + adjusted)
    rows = rows.withColumn("capped", (F.col("n_words") < 25) & (F.col("raw") > 0.60)).withColumn("base", _clamp(F.when(F.col("capped"), 0.60).otherwise(F.col("raw")), 0.0, 4.0))
    tags = [
        (F.col("rule") > 0, "rule-language"), (F.col("many") > 0, "measured-values"), (F.col("near") | F.col("far"), "foreign-subject"), (F.col("heading"), "heading-start"), (F.col("middle"), "mid-sentence"), (F.col("access_count") > 0, "accessed"),
        (F.col("pointer") > 0, "pointer-density"), (F.col("n_findings") >= 1, "finding-rows"), (F.col("ephemera") > 0, "ephemera"), (F.col("past"), "superseded"), (F.col("front"), "frontmatter-only"), (short | thin, "thin-content"), (F.col("capped"), "thin-cap"),
    ]
    rows = rows.withColumn("reasons", F.array_compact(F.array(F.col("archetype"), *(F.when(holds, F.lit(tag)) for holds, tag in tags))))
    # a row each time: filters on the score stay above, instead of repeating all of its arithmetic in one method that is too large to compile
    kept = refined(rows).select(*columns, "archetype", F.explode_outer(F.array(F.struct("score", "reasons"))).alias("found"))
    return kept.select(*columns, "archetype", "found.score", "found.reasons")


def refined(rows: DataFrame) -> DataFrame:
    """score from base for rows without a file, whose text tells a status from a lasting fact; others keep it. Needs measured()'s columns."""
    status, durable = F.col("n_status"), F.col("n_durable")
    found = [
        (F.col("opener"), F.lit(-1.2), "status-opener"),
        (status > 0, -F.least(F.lit(1.5), 0.15 * status), "status-vocabulary"),
        (F.col("second_person"), F.lit(-0.5), "second-person"),
        (F.col("n_commits") >= 2, F.lit(-0.3), "commit-hashes"),
        (F.col("n_measures") >= 2, F.lit(0.5), "real-measurements"),
        (durable > 0, F.least(F.lit(1.0), 0.35 * durable), "durable-fact-language"),
        (F.col("dated"), F.lit(0.5), "dated-fact"),
    ]
    delta = _clamp(reduce(lambda a, b: a + b, (F.when(holds, by).otherwise(0.0) for holds, by, _ in found)), -2.8, 1.5)
    lifted = (F.col("n_spaced") < 40) & (durable >= 1) & (status <= 1)
    organic = F.col("source_file").isNull()
    base = F.when(lifted, F.greatest("base", F.lit(2.2))).otherwise(F.col("base"))
    tags = F.array_compact(F.array(*(F.when(organic & holds, F.lit(tag)) for holds, _, tag in found), F.when(organic & lifted, F.lit("short-definitional-floor"))))
    return rows.withColumn("score", F.when(organic, _clamp(base + delta, 0.0, 4.0)).otherwise(F.col("base"))).withColumn("reasons", F.concat("reasons", tags))


def excluded(prefixes: list[str]) -> Column:
    """Whether a row's file starts with one of the prefixes; rows without a file never are."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.col("source_file").startswith(p) for p in prefixes), F.lit(False)), F.lit(False))


def _digest(x: Column) -> Column:
    return F.sha2(x, 256)


def duplicates_of(shared: DataFrame, compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """Digests of values, and paths, of the shared tier to hold candidates against. compat compares a stripped candidate with raw shared values."""
    return shared.select(_digest(F.col("value") if compat else stripped("value")).alias("plain")).distinct(), shared.select("path").distinct()


def not_shared(rows: DataFrame, shared: DataFrame, compat: bool = True) -> DataFrame:
    values, paths = duplicates_of(shared, compat)
    rows = rows.withColumn("plain", _digest(stripped("value"))).join(values, "plain", "left_anti").drop("plain")
    return rows.withColumn("shared_path", F.concat(F.lit("shared/"), "path")).join(paths.withColumnRenamed("path", "shared_path"), "shared_path", "left_anti").drop("shared_path")


def candidates(entries: DataFrame, project_ids: list[str], limit: int = CANDIDATES, prefixes: list[str] | None = None, with_ttl: bool = False, compat: bool = True) -> DataFrame:
    """Of each project the best rows to share, duplicates of shared ones left out before they are counted."""
    pool = entries.filter((F.col("scope") == "project") & (F.col("embed_state") == "embedded") & ~excluded(prefixes or []))
    pool = pool if with_ttl else pool.filter("ttl_days IS NULL")
    rows = scored(pool, project_ids).filter(F.col("score") >= FLOOR)
    rows = rows.withColumn("reasons", F.when(F.col("ttl_days").isNotNull(), F.concat(F.array(F.lit("ttl-row")), "reasons")).otherwise(F.col("reasons")))
    rows = not_shared(rows, entries.filter("scope = 'shared'"), compat)
    order = Window.partitionBy("project_id").orderBy(F.desc(F.round("score", 9)), F.desc("created_at"), "hash")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).withColumn("preview", preview("value"))


def upsert_queue(queue: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """The queue with the candidates; a row that was there keeps its created_at. is_new marks the others."""
    kept = ["path", "value", "source_file", "score", "reasons"]
    both = queue.select("project_id", "hash", F.struct(*kept, "created_at", "updated_at").alias("was")).join(found.select("project_id", "hash", F.struct(*kept).alias("now")), ["project_id", "hash"], "full_outer")
    came = F.col("now").isNotNull()
    return both.select("project_id", "hash", *(F.when(came, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in kept), F.coalesce("was.created_at", F.lit(now)).alias("created_at"), F.when(came, F.lit(now)).otherwise(F.col("was.updated_at")).alias("updated_at"), (came & F.col("was").isNull()).alias("is_new"))


def review_order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("score"), "created_at", "hash")


def discarded(queue: DataFrame, project_id: str, hash_: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The queue without a project's rows, or without the one of this hash; and what was taken out."""
    gone = (F.col("project_id") == project_id) & (F.lit(True) if hash_ is None else F.col("hash") == hash_)
    return queue.filter(~F.coalesce(gone, F.lit(False))), queue.filter(gone)


#: A linear scorer for evaluation only: the sign of each reason.
SIGNS = {
    "rule-language": 1, "measured-values": 1, "foreign-subject": 1, "heading-start": 1, "accessed": 1, "durable-fact-language": 1, "real-measurements": 1, "dated-fact": 1, "short-definitional-floor": 1,
    "mid-sentence": -1, "pointer-density": -1, "finding-rows": -1, "ephemera": -1, "superseded": -1, "frontmatter-only": -1, "thin-content": -1, "thin-cap": -1, "status-opener": -1, "status-vocabulary": -1, "second-person": -1, "commit-hashes": -1,
}


def sign_score(scored_rows: DataFrame) -> DataFrame:
    """scored() rows with sign_score, the sum of their reasons' signs, to compare the score with."""
    signs = F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair))
    return scored_rows.withColumn("sign_score", F.aggregate("reasons", F.lit(0), lambda a, r: a + F.coalesce(signs[r], F.lit(0))))


def capacity(queue: DataFrame, total: int) -> DataFrame:
    """Of each project its rows, its reservation and whether it borrows."""
    used = queue.groupBy("project_id").agg(F.count("*").alias("used"))
    n = F.count("*").over(Window.partitionBy())
    return used.withColumn("reserved", F.floor(F.lit(total) / n)).withColumn("borrowing", F.col("used") > F.col("reserved"))


def kept_counts(counts: DataFrame, total: int) -> DataFrame:
    """How many rows of each project stay when, while there are more than `total`, the project with the most rows loses one (of equals the first by id).

    In closed form: all projects are cut to one level, and of those that reach the level the last by id keep one more while there is room.
    """
    by_size, everything = Window.orderBy("used", "project_id"), Window.partitionBy()
    rows = counts.withColumns({"n": F.count("*").over(everything), "all_used": F.sum("used").over(everything), "place": F.row_number().over(by_size), "below": F.coalesce(F.sum("used").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumn("level_here", F.floor((F.lit(total) - F.col("below")) / (F.col("n") - F.col("place") + 1)))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("level_here") < F.col("used"), F.col("level_here")), F.when(F.col("level_here") < F.col("used"), F.col("place"))).over(everything))
    rows = rows.withColumn("cut", F.least("used", F.coalesce("level", "used"))).withColumn("spare", F.lit(total) - F.sum("cut").over(everything))
    over = Window.partitionBy(F.col("used") > F.col("cut")).orderBy(F.desc("project_id"))
    more = (F.col("used") > F.col("cut")) & (F.row_number().over(over) <= F.col("spare"))
    return rows.select("project_id", "used", F.when(F.col("all_used") <= total, F.col("used")).otherwise(F.greatest(F.lit(0), F.col("cut")) + F.when(more, 1).otherwise(0)).alias("kept"))


def evicted(queue: DataFrame, total: int) -> DataFrame:
    """Rows that leave: each project's weakest, the oldest of equals first."""
    counts = kept_counts(queue.groupBy("project_id").agg(F.count("*").alias("used")), total)
    weakest = Window.partitionBy("project_id").orderBy("score", "created_at", "hash")
    return queue.withColumn("place", F.row_number().over(weakest)).join(counts, "project_id").filter(F.col("place") <= F.col("used") - F.col("kept")).drop("place", "used", "kept")


def promote(queue: DataFrame, shared: DataFrame, limit: int, compat: bool = False) -> DataFrame:
    """Of each project the best `limit` queue rows, those that the shared tier holds already marked as skipped; the others have their shared path and hash."""
    top = queue.withColumn("place", F.row_number().over(review_order("project_id"))).filter(F.col("place") <= limit)
    values, paths = duplicates_of(shared, compat)
    top = top.withColumn("plain", _digest(stripped("value"))).join(values.withColumn("same_value", F.lit(True)), "plain", "left").drop("plain").withColumn("shared_path", F.concat(F.lit("shared/"), "path"))
    top = top.join(paths.select(F.col("path").alias("shared_path"), F.lit(True).alias("same_path")), "shared_path", "left")
    return top.withColumn("skipped", F.coalesce("same_value", F.lit(False)) | F.coalesce("same_path", F.lit(False))).withColumn("shared_hash", content_hash("shared_path", "value")).drop("same_value", "same_path")
