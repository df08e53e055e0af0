"""More of the engine's queries: promotion, queue, sync, events, chunks and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.catalog import CTX, NOW, E, query, sample_entries, table
from lorekeep.functions import text as tx
from lorekeep.operators import chunk, lifecycle, promotion, snippets, sync
from lorekeep.streaming import events as ev

#: Entries whose texts have what invented prose lacks: (id, path, source_file, project_id, access_count, value).
SAMPLES = [
    (-1, "docs/adr/0007-cache.md", "docs/adr/0007-cache.md", "p1", 3, "# Cache decision\nNever evict by size. Always prefer the contract: it is required by design and fails open silently. " * 3),
    (-2, "docs/work/plan-sweep.md", "docs/work/plan-sweep.md", "p1", 0, "Measured throughput was 120 ms over 40 files, observed p95 of 14.4 ms and peak rss 20 MB; best-of-3 passed 12. " * 5),
    (-3, "docs/README.md", "docs/README.md", "p2", 1, "| [a](a.md) | b.md |\n| [c](c.md) | d.md |\n| F-12 | 1.2 |\n| F-13 | 1.3 |\n| F-14 | 1.4 |\n"),
    (-4, "note.md", None, "p2", 0, "Done: merged and pushed, worktree cleaned, 174 passed, exit 0, see 0a1b2c3d and 9f8e7d6c. You can rerun with your own cron job."),
    (-5, "note2.md", None, "p3", 7, "(2024-05-01): the root cause must be a contract; one owner per table holds, never two. It took 12 ms and 3 s."),
    (-6, "docs/reviews/a1-lens.md", "docs/reviews/a1-lens.md", "p3", 0, "status: open. Gate: AC: acceptance criteria, wave 2, closes: #1234, superseded and no longer true.\n| A-1 | x |\n"),
    (-7, "x/guide/skills.md", "x/guide/skills.md", "p4", 2, "---\nupdated: today\n---\nthis and p1 and p2 are named here, ; start."),
    (-8, "docs/explanation/architecture.md", "docs/explanation/architecture.md", "p0", 0, "<invoke name=\"a\"><parameter name=\"b\">text</parameter></invoke>"),
    (-9, "0123456789abcdef0123456789abcdef.md", "x.md", "p0", 0, ", and so it goes on without an end in sight, does not ever need an index here."),
]
PROJECTS = ["p0", "p1", "p2", "p3", "p4"]


def _quoted(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


ROWS = f"""{E}, rows_ AS (SELECT id, path, source_file, project_id, access_count, value, hash, created_at, scope, embed_state, ttl_days FROM entries
  UNION ALL SELECT id, path, source_file, project_id, access_count, value, sha256(path || value), 1704067200, 'project', 'embedded', NULL FROM (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in SAMPLES)}) v(id, path, source_file, project_id, access_count, value))"""


def scored_rows(spark, sf_dir):
    more = spark.createDataFrame(SAMPLES, "id long, path string, source_file string, project_id string, access_count long, value string")
    more = more.select("*", tx.content_hash("path", "value").alias("hash"), F.lit(1704067200).cast("long").alias("created_at"), F.lit("project").alias("scope"), F.lit("embedded").alias("embed_state"), F.lit(None).cast("double").alias("ttl_days"))
    return sample_entries(spark, sf_dir).select(*more.columns).unionByName(more)


def _re2(pattern: str) -> str:
    """A pattern of the engine as RE2 reads it: the look-ahead consumes, and letters beyond ASCII have been replaced before."""
    return pattern.replace("(?=[^.]{0,40}", "(?:[^.]{0,40}").replace("'", "''")


def _n(pattern: str, of: str = "v") -> str:
    return f"len(regexp_extract_all({of}, '{_re2(pattern)}'))"


_P = promotion
NAME = "regexp_extract(lower(path), '[^/]*$')"
ARCHETYPE = f"""CASE WHEN {_n(_P.TURN_MARKUP)} >= 2 THEN 'turn-mirror' WHEN coalesce(source_file, '') = '' OR regexp_matches(name, '(?i)^[0-9a-f]{{32,}}\\.md$') THEN 'organic-note' WHEN name IN ('readme.md', 'changelog.md', 'index.md') THEN 'doc-index'
 WHEN contains(p, '/adr/') OR contains(p, '/decisions/') OR (regexp_matches(name, '^\\d{{4}}-') AND NOT regexp_matches(name, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) THEN 'adr' WHEN contains(name, 'charter') THEN 'charter'
 WHEN contains(p, '/explanation/') OR contains(p, '/design/') OR contains(name, 'architecture') THEN 'explanation' WHEN contains(p, '/plans/') OR starts_with(name, 'plan') OR contains(name, '-plan') OR ends_with(name, 'plan.md') THEN 'plan'
 WHEN contains(p, '/reviews/') OR contains(name, 'review') OR contains(name, 'moe-') OR regexp_matches(name, '^[a-z]\\d+-') OR contains(name, 'findings') OR contains(name, 'incident') THEN 'review'
 WHEN contains(name, 'sweep') OR contains(name, 'benchmark') OR contains(name, '-perf') OR contains(name, 'perf-') THEN 'measurement' WHEN contains(p, '/archive/') OR contains(name, 'research') OR contains(name, 'synthesis') OR contains(name, 'report') THEN 'research-synthesis'
 WHEN contains(p, '/reference/') OR contains(p, '/how-to/') OR contains(p, '/tutorial/') THEN 'reference' WHEN contains(p, '/guide') OR name IN ('skills.md', 'getting-started.md', 'glossary.md') THEN 'catalog-page'
 WHEN contains(p, '/changelog/') OR contains(p, '/releases/') THEN 'changelog-entry' ELSE 'work-note' END"""
READ = f"{ROWS}, seen AS (SELECT *, lower(path) AS p, {NAME} AS name, regexp_replace(value, '[^\\x00-\\x7F]', 'q', 'g') AS v, greatest(len(regexp_extract_all(value, '{_re2(_P.WORD)}')), 0) AS nw FROM rows_), arch AS (SELECT *, {ARCHETYPE} AS archetype FROM seen)"
PRIOR = "CASE archetype " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _P.PRIORS.items()) + " END"
FOREIGN = "len(list_filter(['p0', 'p1', 'p2', 'p3', 'p4'], lambda x: x <> project_id AND contains(lower({}), x)))"
FEATURES = f"""{READ}, ft AS (SELECT *, least(0.75, 0.3::DOUBLE * 100.0 * {_n(_P.RULE_LANGUAGE)} / greatest(nw, 1)) AS f_rule, {_n(_P.MEASURE_WORDS)} AS mw, {_n(_P.NUMBER_WITH_UNIT)} AS nu, {FOREIGN.format('value[1:250]')} > 0 AS f_near, {FOREIGN.format('value')} >= 2 AS f_far,
 starts_with(ltrim(value, ' \t\n\r'), '#') AS f_head, regexp_matches(ltrim(value, ' \t\n\r'), '^[\\p{{Ll}}),;]') AS f_mid, list_filter(string_split(value, chr(10)), lambda x: trim(x, ' \t\r') <> '') AS ls,
 100.0::DOUBLE * {_n(_P.LINK)} / greatest(nw, 1) AS f_links, 100.0::DOUBLE * {_n(_P.DOC_NAME)} / greatest(nw, 1) AS f_names, {_n(_P.VERSION_ROW)} AS f_vers, {_n(_P.FINDING_ROW)} AS f_find, least(0.65, 0.22::DOUBLE * 100.0 * {_n(_P.EPHEMERA)} / greatest(nw, 1)) AS f_eph,
 regexp_matches(v, '{_re2(_P.SUPERSEDED)}') AS f_past, regexp_matches(ltrim(value, ' \t\n\r'), '{_re2(_P.FRONTMATTER)}') AS f_front, {_n(_P.STATUS_WORDS)} AS ns, {_n(_P.DURABLE)} AS nd FROM arch),
f2 AS (SELECT *, CASE WHEN mw >= 1 AND nu >= 1 THEN least(0.5, 0.12::DOUBLE * least(mw, 4) + 0.05::DOUBLE * least(nu, 4)) WHEN mw >= 2 THEN 0.15 ELSE 0.0 END::DOUBLE AS f_meas,
 least(1.0, (CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*\\|')))::DOUBLE / greatest(len(ls), 1) >= 0.55 THEN 0.3 ELSE 0 END + CASE WHEN f_links >= 1.5 THEN 0.45 ELSE 0 END + CASE WHEN f_names >= 2 THEN 0.35 ELSE 0 END + CASE WHEN f_vers >= 3 THEN 0.35 ELSE 0 END)::DOUBLE) AS f_ptr FROM ft),
f3 AS (SELECT *, {PRIOR} + greatest(-1.6, least(CASE WHEN archetype IN ('doc-index', 'turn-mirror') THEN 0.15 ELSE 1.3 END, f_rule + f_meas + CASE WHEN f_near THEN 0.25 ELSE 0 END + CASE WHEN f_far THEN 0.1 ELSE 0 END + CASE WHEN f_head THEN 0.12 ELSE 0 END - CASE WHEN f_mid THEN 0.18 ELSE 0 END
 + CASE WHEN access_count > 0 THEN least(0.2, 0.05::DOUBLE * ln(access_count + 1)) ELSE 0 END - f_ptr - CASE WHEN f_find >= 3 THEN 0.45 WHEN f_find >= 1 THEN 0.28 ELSE 0 END - f_eph - CASE WHEN f_past THEN 0.4 ELSE 0 END - CASE WHEN f_front AND length(value) < 900 THEN 0.55 WHEN f_front THEN 0.25 ELSE 0 END
 - CASE WHEN length(value) < 420 THEN 0.35 ELSE 0 END - CASE WHEN nw < 60 THEN 0.25 ELSE 0 END)) AS raw FROM f2),
f4 AS (SELECT *, nw < 25 AND raw > 0.6 AS capped, greatest(0.0, least(4.0, CASE WHEN nw < 25 AND raw > 0.6 THEN 0.6 ELSE raw END)) AS base, source_file IS NULL AS organic,
 regexp_matches(v[1:80], '{_re2(_P.STATUS_OPENER)}') AS r1, regexp_matches(v, '{_re2(_P.SECOND_PERSON)}') AS r3, {_n(_P.COMMIT)} >= 2 AS r4, len(regexp_extract_all(regexp_replace(v, '{_re2(_P.TEST_COUNTS)}', ' ', 'g'), '{_re2(_P.MEASURE)}')) >= 2 AS r5, regexp_matches(v[1:120], '{_re2(_P.DATED_FACT)}') AS r7,
 len(regexp_extract_all(value, '\\S+')) < 40 AND nd >= 1 AND ns <= 1 AS lifted FROM f3),
done AS (SELECT *, CASE WHEN organic THEN greatest(0.0, least(4.0, CASE WHEN lifted THEN greatest(base, 2.2) ELSE base END + greatest(-2.8, least(1.5, CASE WHEN r1 THEN -1.2 ELSE 0 END - least(1.5, 0.15::DOUBLE * ns) - CASE WHEN r3 THEN 0.5 ELSE 0 END - CASE WHEN r4 THEN 0.3 ELSE 0 END + CASE WHEN r5 THEN 0.5 ELSE 0 END + least(1.0, 0.35::DOUBLE * nd) + CASE WHEN r7 THEN 0.5 ELSE 0 END)))) ELSE base END AS score,
 array_to_string(list_filter([archetype, CASE WHEN f_rule > 0 THEN 'rule-language' END, CASE WHEN f_meas > 0 THEN 'measured-values' END, CASE WHEN f_near OR f_far THEN 'foreign-subject' END, CASE WHEN f_head THEN 'heading-start' END, CASE WHEN f_mid THEN 'mid-sentence' END, CASE WHEN access_count > 0 THEN 'accessed' END,
 CASE WHEN f_ptr > 0 THEN 'pointer-density' END, CASE WHEN f_find >= 1 THEN 'finding-rows' END, CASE WHEN f_eph > 0 THEN 'ephemera' END, CASE WHEN f_past THEN 'superseded' END, CASE WHEN f_front THEN 'frontmatter-only' END, CASE WHEN length(value) < 420 OR nw < 60 THEN 'thin-content' END, CASE WHEN capped THEN 'thin-cap' END,
 CASE WHEN organic AND r1 THEN 'status-opener' END, CASE WHEN organic AND ns > 0 THEN 'status-vocabulary' END, CASE WHEN organic AND r3 THEN 'second-person' END, CASE WHEN organic AND r4 THEN 'commit-hashes' END, CASE WHEN organic AND r5 THEN 'real-measurements' END, CASE WHEN organic AND nd > 0 THEN 'durable-fact-language' END,
 CASE WHEN organic AND r7 THEN 'dated-fact' END, CASE WHEN organic AND lifted THEN 'short-definitional-floor' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f4)"""


@query(f"WITH {READ} SELECT id, archetype FROM arch")
def archetype_classify(spark, sf_dir):
    return scored_rows(spark, sf_dir).select("id", promotion.archetype().alias("archetype"))


@query(f"WITH {FEATURES} SELECT id, round(score, 6) AS score, reasons FROM done")
def promotion_score(spark, sf_dir):
    return promotion.scored(scored_rows(spark, sf_dir), PROJECTS).select("id", F.round("score", 6).alias("score"), F.concat_ws(",", "reasons").alias("reasons"))


@query(f"WITH {FEATURES} SELECT id, f_near OR f_far AS foreign_subject FROM done")
def foreign_subject(spark, sf_dir):
    return promotion.scored(scored_rows(spark, sf_dir), PROJECTS).select("id", F.array_contains("reasons", "foreign-subject").alias("foreign_subject"))


CONV = f"""notes AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g') AS v, text AS value FROM conversations),
n2 AS (SELECT *, {_n(_P.STATUS_WORDS)} AS ns, {_n(_P.DURABLE)} AS nd, regexp_matches(v[1:80], '{_re2(_P.STATUS_OPENER)}') AS r1, regexp_matches(v, '{_re2(_P.SECOND_PERSON)}') AS r3, {_n(_P.COMMIT)} >= 2 AS r4,
  len(regexp_extract_all(regexp_replace(v, '{_re2(_P.TEST_COUNTS)}', ' ', 'g'), '{_re2(_P.MEASURE)}')) >= 2 AS r5, regexp_matches(v[1:120], '{_re2(_P.DATED_FACT)}') AS r7, len(regexp_extract_all(value, '\\S+')) < 40 AS brief FROM notes)"""


@query(f"""WITH {CONV} SELECT id, ns::INT AS n_status, nd::INT AS n_durable, r3 AS second_person, round(greatest(0.0, least(4.0, CASE WHEN brief AND nd >= 1 AND ns <= 1 THEN 2.2 ELSE 2.0 END
 + greatest(-2.8, least(1.5, CASE WHEN r1 THEN -1.2 ELSE 0 END - least(1.5, 0.15::DOUBLE * ns) - CASE WHEN r3 THEN 0.5 ELSE 0 END - CASE WHEN r4 THEN 0.3 ELSE 0 END + CASE WHEN r5 THEN 0.5 ELSE 0 END + least(1.0, 0.35::DOUBLE * nd) + CASE WHEN r7 THEN 0.5 ELSE 0 END)))), 6) AS score FROM n2""")
def organic_refine(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("value"), F.lit("p0").alias("project_id"), F.lit(None).cast("string").alias("source_file"), F.lit(2.0).alias("base"), F.array().cast("array<string>").alias("reasons"))
    return promotion.refined(promotion.measured(notes)).select("id", "n_status", "n_durable", "second_person", F.round("score", 6).alias("score"))


POOL = "pool AS (SELECT * FROM done WHERE scope = 'project' AND embed_state = 'embedded' AND ttl_days IS NULL AND score >= 0.4 AND coalesce(NOT starts_with(source_file, 'docs/11'), true)), shared_rows AS (SELECT value, path FROM rows_ WHERE scope = 'shared' UNION ALL SELECT 'Done:mergedandpushed,worktreecleaned,174passed,exit0,see0a1b2c3dand9f8e7d6c.Youcanrerunwithyourowncronjob.', 'literal')"
CHOSEN = f"{FEATURES}, {POOL}, fresh AS (SELECT * FROM pool WHERE regexp_replace(value, '\\s', '', 'g') NOT IN (SELECT value FROM shared_rows) AND 'shared/' || path NOT IN (SELECT path FROM shared_rows)), chosen AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, created_at DESC, hash) AS place FROM fresh QUALIFY place <= 20)"


def with_literal(spark, rows):
    """The rows and a shared one whose value has no white space, as a stripped candidate would."""
    value = "".join(SAMPLES[3][5].split())
    extra = spark.createDataFrame([(-100, "literal", None, "p9", 0, value, "h", 0, "shared", "embedded", None)], rows.schema)
    return rows.unionByName(extra)


def chosen(spark, sf_dir):
    return promotion.candidates(with_literal(spark, scored_rows(spark, sf_dir)), PROJECTS, prefixes=["docs/11"])


@query(f"WITH {CHOSEN} SELECT id, project_id, hash, place, CASE WHEN length(value) > 300 THEN value[1:299] || '…' ELSE value END AS preview FROM chosen")
def extract_candidates(spark, sf_dir):
    return chosen(spark, sf_dir).select("id", "project_id", "hash", "place", "preview")


@query(f"WITH {CHOSEN} SELECT id FROM fresh")
def extract_dedup(spark, sf_dir):
    rows = with_literal(spark, scored_rows(spark, sf_dir))
    pool = promotion.scored(rows.filter((F.col("scope") == "project") & (F.col("embed_state") == "embedded") & F.col("ttl_days").isNull() & ~promotion.excluded(["docs/11"])), PROJECTS).filter(F.col("score") >= promotion.FLOOR)
    return promotion.not_shared(pool, rows.filter("scope = 'shared'")).select("id")


QUEUE = f"{E}, queue AS (SELECT project_id, hash, path, value, source_file, ((id * 37) % 400) / 100.0::DOUBLE AS score, created_at, created_at AS updated_at FROM entries WHERE scope = 'project')"


def sample_queue(spark, sf_dir):
    rows = sample_entries(spark, sf_dir).filter("scope = 'project'")
    return rows.select("project_id", "hash", "path", "value", "source_file", ((F.col("id") * 37) % 400 / 100.0).alias("score"), F.array().cast("array<string>").alias("reasons"), "created_at", F.col("created_at").alias("updated_at"))


@query(f"""WITH {QUEUE}, old AS (SELECT * FROM queue WHERE created_at % 7200 = 0), new AS (SELECT * REPLACE (score + 1 AS score) FROM queue WHERE created_at % 10800 = 0)
SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.hash, o.hash) AS hash, round(coalesce(n.score, o.score), 6) AS score, coalesce(o.created_at, {NOW}) AS created_at, CASE WHEN n.hash IS NOT NULL THEN {NOW} ELSE o.updated_at END AS updated_at, o.hash IS NULL AS is_new
FROM old o FULL JOIN new n USING (project_id, hash)""")
def queue_upsert(spark, sf_dir):
    queue = sample_queue(spark, sf_dir)
    new = queue.filter("created_at % 10800 = 0").withColumn("score", F.col("score") + 1)
    return promotion.upsert_queue(queue.filter("created_at % 7200 = 0"), new, NOW).select("project_id", "hash", F.round("score", 6).alias("score"), "created_at", "updated_at", "is_new")


@query(f"WITH {QUEUE} SELECT project_id, hash, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, created_at, hash) AS place FROM queue QUALIFY place <= 20")
def queue_review(spark, sf_dir):
    return sample_queue(spark, sf_dir).withColumn("place", F.row_number().over(promotion.review_order("project_id"))).filter("place <= 20").select("project_id", "hash", "score", "place")


@query(f"WITH {QUEUE} SELECT project_id, count(*) AS n, round(avg({NOW} - created_at), 6) AS mean_wait FROM queue GROUP BY ALL")
def queue_stats(spark, sf_dir):
    return sample_queue(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n"), F.round(F.avg(NOW - F.col("created_at")), 6).alias("mean_wait"))


@query(f"WITH {QUEUE}, u AS (SELECT project_id, count(*) AS used FROM queue GROUP BY ALL) SELECT project_id, used, (300 // (SELECT count(*) FROM u))::BIGINT AS reserved, used > 300 // (SELECT count(*) FROM u) AS borrowing FROM u")
def queue_capacity(spark, sf_dir):
    return promotion.capacity(sample_queue(spark, sf_dir), 300)


UNEVEN = "hash < 'c' OR project_id IN ('p0', 'p3')"


@query(f"""WITH {QUEUE}, lop AS (SELECT * FROM queue WHERE {UNEVEN}), n AS (SELECT project_id, hash, row_number() OVER (PARTITION BY project_id ORDER BY score, created_at, hash) AS weak, count(*) OVER (PARTITION BY project_id) AS used FROM lop),
turns AS (SELECT *, row_number() OVER (ORDER BY used - weak + 1 DESC, project_id) AS turn FROM n) SELECT project_id, hash FROM turns WHERE turn <= (SELECT count(*) FROM lop) - 200""")
def queue_evict(spark, sf_dir):
    return promotion.evicted(sample_queue(spark, sf_dir).filter(UNEVEN), 200).select("project_id", "hash")


@query(f"""WITH {QUEUE}, top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, created_at, hash) AS place FROM queue QUALIFY place <= 30)
SELECT project_id, hash, regexp_replace(value, '\\s', '', 'g') IN (SELECT regexp_replace(value, '\\s', '', 'g') FROM entries WHERE scope = 'shared') OR 'shared/' || path IN (SELECT path FROM entries WHERE scope = 'shared') AS skipped, sha256('shared/' || path || value) AS shared_hash FROM top""")
def promote_from_queue(spark, sf_dir):
    return promotion.promote(sample_queue(spark, sf_dir), sample_entries(spark, sf_dir).filter("scope = 'shared'"), 30).select("project_id", "hash", "skipped", "shared_hash")


# Sync: the banks of two sites, which hold different languages; rows of some ratings have been deleted

SYNC = f"""{E}, local_ AS (SELECT * FROM entries WHERE section <> 'en'), remote AS (SELECT * FROM entries WHERE section <> 'de'), lt AS (SELECT hash, scope, 100 + id AS deleted_at FROM entries WHERE rating > 0.85 AND scope IS NOT NULL), rt AS (SELECT hash, scope, 200 + id AS deleted_at FROM entries WHERE access_count = 6 AND scope IS NOT NULL),
new AS (SELECT * FROM remote r WHERE scope IS NOT NULL AND NOT EXISTS (FROM lt WHERE lt.hash = r.hash AND lt.scope = r.scope) AND NOT EXISTS (FROM local_ l WHERE l.path = r.path AND l.hash = r.hash AND l.scope = r.scope AND (l.scope = 'shared' OR l.project_id = r.project_id AND coalesce(l.context_label, '') = coalesce(r.context_label, '')))),
fresh AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY path, hash, scope, CASE WHEN scope = 'shared' THEN '' ELSE project_id END, CASE WHEN scope = 'shared' THEN '' ELSE coalesce(context_label, '') END ORDER BY id) = 1),
own AS (SELECT * FROM local_ QUALIFY scope IS NULL OR row_number() OVER (PARTITION BY path, hash, scope, CASE WHEN scope = 'shared' THEN '' ELSE project_id END, CASE WHEN scope = 'shared' THEN '' ELSE coalesce(context_label, '') END ORDER BY id) = 1)"""


def sync_pair(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    stones = lambda gone, base: entries.filter(gone).filter("scope IS NOT NULL").select("hash", "scope", (base + F.col("id")).alias("deleted_at"))
    return entries.filter("section <> 'en'"), entries.filter("section <> 'de'"), stones("rating > 0.85", 100), stones("access_count = 6", 200)


@query(f"WITH {SYNC} SELECT id, hash, embed_state FROM own UNION ALL SELECT id - (SELECT min(id) FROM remote) + (SELECT max(id) FROM local_) + 1, hash, 'pending' FROM fresh")
def sync_merge(spark, sf_dir):
    local, remote, stones, _ = sync_pair(spark, sf_dir)
    return sync.merged(local, remote, stones).select("id", "hash", "embed_state")


@query(f"WITH {SYNC} SELECT id FROM local_ l WHERE NOT EXISTS (FROM rt WHERE rt.hash = l.hash AND rt.scope = coalesce(l.scope, 'workspace'))")
def sync_apply_tombstones(spark, sf_dir):
    local, _, _, stones = sync_pair(spark, sf_dir)
    return sync.apply_stones(local, stones).select("id")


@query(f"WITH {SYNC} SELECT id, CASE WHEN embed_state = 'embedded' AND workspace_id IS NULL AND EXISTS (FROM remote r WHERE r.hash = l.hash AND coalesce(r.scope, 'workspace') = coalesce(l.scope, 'workspace')) THEN 'pending' ELSE embed_state END AS embed_state FROM local_ l")
def sync_reindex(spark, sf_dir):
    local, remote, _, _ = sync_pair(spark, sf_dir)
    return sync.reindexed(local, remote).select("id", "embed_state")


@query(f"WITH {SYNC}, both_ AS (SELECT * FROM lt UNION ALL SELECT * FROM rt) SELECT hash, scope, max(deleted_at) AS deleted_at FROM both_ GROUP BY ALL")
def tombstone_upsert(spark, sf_dir):
    _, _, a, b = sync_pair(spark, sf_dir)
    return sync.latest_stones(a.unionByName(b))


@query(f"WITH {SYNC} SELECT * FROM lt WHERE deleted_at >= 300 UNION ALL SELECT * FROM rt WHERE deleted_at >= 300 AND NOT EXISTS (FROM lt WHERE lt.hash = rt.hash AND lt.scope = rt.scope)")
def tombstone_union(spark, sf_dir):
    _, _, a, b = sync_pair(spark, sf_dir)
    return sync.expired(sync.stones_union(a, b), 300)


# File events

EVENTS = "fe AS (SELECT event_id AS seq, event_type AS project_id, 'root/' || (user_id % 10) || '/' || (user_id % 7) || '/f' || user_id || '.md' AS path, ['Created', 'Changed', 'Deleted', 'Renamed'][event_id % 4 + 1] AS kind FROM events)"


def file_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("project_id"), F.format_string("root/%d/%d/f%d.md", F.col("user_id") % 10, F.col("user_id") % 7, "user_id").alias("path"),
        F.element_at(F.array(*map(F.lit, ("Created", "Changed", "Deleted", "Renamed"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
    )


@query(f"WITH {EVENTS} SELECT project_id, path, max(seq) AS seq, arg_max(kind, seq) AS kind FROM fe GROUP BY ALL")
def event_coalesce(spark, sf_dir):
    return ev.coalesced(file_events(spark, sf_dir))


WATCHED = ["root", "root/1", "root/2/3", "root/5"]


@query(f"WITH {EVENTS}, w AS (SELECT unnest({WATCHED}) AS watch_path), k AS (SELECT DISTINCT project_id FROM fe) SELECT seq, arg_max(watch_path, length(watch_path)) AS watch_path FROM fe, w WHERE starts_with(path, watch_path || '/') AND (watch_path <> 'root' OR project_id = (SELECT min(project_id) FROM k)) GROUP BY seq")
def watch_routing(spark, sf_dir):
    rows = file_events(spark, sf_dir)
    first = rows.agg(F.min("project_id").alias("least"))
    watches = rows.select("project_id").distinct().join(F.broadcast(first)).select("project_id", "least", F.explode(F.array(*map(F.lit, WATCHED))).alias("path")).filter("path <> 'root' OR project_id = least").drop("least")
    return ev.routed(rows, watches).select("seq", "watch_path")


@query(f"WITH {EVENTS}, j AS (SELECT project_id, path[1:6] AS watch_path, seq FROM fe), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, watch_path ORDER BY seq) AS round, min(seq) OVER (PARTITION BY project_id, watch_path) AS turn FROM j) SELECT project_id, watch_path, seq, round::INT AS round, (row_number() OVER (PARTITION BY project_id ORDER BY round, turn))::INT AS place FROM r")
def round_robin(spark, sf_dir):
    return ev.fair_order(file_events(spark, sf_dir).select("project_id", F.substring("path", 1, 6).alias("watch_path"), "seq"))


DIGEST = f"{EVENTS}, l AS (SELECT project_id, path, max(seq) AS seq, arg_max(kind, seq) AS kind FROM fe GROUP BY ALL), x AS (SELECT *, CASE WHEN seq % 5 <> 0 THEN md5(path || (seq % 3)) END AS content_hash, CASE WHEN kind = 'Renamed' THEN path || '.old' END AS old_path FROM l), known AS (SELECT project_id, path, md5(path || '1') AS hash FROM l WHERE seq % 2 = 0 UNION ALL SELECT project_id, path || '.old', 'x' FROM l WHERE seq % 3 = 0), a AS (SELECT x.*, CASE WHEN kind = 'Deleted' OR content_hash IS NULL THEN 'delete' WHEN content_hash = known.hash THEN 'touch' ELSE 'replace' END AS action FROM x LEFT JOIN known USING (project_id, path))"


def digest_inputs(spark, sf_dir):
    last = ev.coalesced(file_events(spark, sf_dir))
    rows = last.withColumn("content_hash", F.when(F.col("seq") % 5 != 0, F.md5(F.concat("path", F.col("seq") % 3)))).withColumn("old_path", F.when(F.col("kind") == "Renamed", F.concat("path", F.lit(".old"))))
    known = last.filter("seq % 2 = 0").select("project_id", "path", F.md5(F.concat("path", F.lit("1"))).alias("hash")).unionByName(last.filter("seq % 3 = 0").select("project_id", F.concat("path", F.lit(".old")).alias("path"), F.lit("x").alias("hash")))
    return rows, known.withColumn("updated_at", F.lit(0).cast("long"))


@query(f"WITH {DIGEST} SELECT project_id, path, seq, action FROM a")
def hash_skip(spark, sf_dir):
    return ev.digest_actions(*digest_inputs(spark, sf_dir)).select("project_id", "path", "seq", "action")


@query(f"""WITH {DIGEST}, gone AS (SELECT project_id, path FROM a WHERE action = 'delete' UNION SELECT project_id, old_path FROM a WHERE old_path IS NOT NULL)
SELECT project_id, path, hash, 0 AS updated_at FROM known k WHERE NOT EXISTS (FROM gone g WHERE g.project_id = k.project_id AND g.path = k.path) AND NOT EXISTS (FROM a WHERE a.action <> 'delete' AND a.project_id = k.project_id AND a.path = k.path)
UNION ALL SELECT project_id, path, content_hash, 9 FROM a WHERE action <> 'delete'""")
def mirror_digest(spark, sf_dir):
    rows, known = digest_inputs(spark, sf_dir)
    return ev.mirrored(known, ev.digest_actions(rows, known), 9)


LEASE = "w AS (SELECT DISTINCT event_type AS project_id, user_id AS n, CASE WHEN user_id % 3 > 0 THEN 'host' || (user_id % 3) END AS lease_owner, user_id % 100 AS lease_until FROM events)"


@query(f"WITH {LEASE}, f AS (SELECT *, coalesce(lease_owner IS NULL OR lease_owner = 'host1' OR lease_until < 50, false) AS free FROM w) SELECT project_id, n, free AS acquired, CASE WHEN free THEN 'host1' ELSE lease_owner END AS lease_owner, CASE WHEN free THEN 110 ELSE lease_until END AS lease_until FROM f")
def lease_acquire(spark, sf_dir):
    watches = table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), F.col("user_id").alias("n"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("host"), F.col("user_id") % 3)).alias("lease_owner"), (F.col("user_id") % 100).alias("lease_until")).distinct()
    return ev.leased(watches, "host1", 50).select("project_id", "n", "acquired", "lease_owner", "lease_until")


@query("""WITH r AS (SELECT event_type AS project_id, (user_id % 50)::VARCHAR AS watch_path, event_id AS seq, event_id % 5 = 0 AS ok FROM events), s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY project_id, watch_path ORDER BY seq) AS spell FROM r),
t AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY project_id, watch_path, spell ORDER BY seq) AS run FROM s), u AS (SELECT *, min(CASE WHEN run >= 5 THEN seq END) OVER (PARTITION BY project_id, watch_path) AS stop FROM t)
SELECT project_id, watch_path, seq, CASE WHEN coalesce(seq >= stop, false) THEN 5 ELSE run END::INT AS failures, CASE WHEN coalesce(seq >= stop, false) THEN 'Stopped' WHEN ok THEN 'Healthy' ELSE 'Retrying' END AS status, CASE WHEN NOT coalesce(seq >= stop, false) AND NOT ok THEN pow(2, run - 1)::BIGINT END AS retry_after FROM u""")
def retry_fsm(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), (F.col("user_id") % 50).cast("string").alias("watch_path"), F.col("event_id").alias("seq"), (F.col("event_id") % 5 == 0).alias("ok"))
    return ev.retry_states(rows)


# Text and chunks


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?m)^#{1,6}\s*', '', 'g'), '`([^`]*)`', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*[-*]\s*', '', 'g'), '[|>]', ' ', 'g'), '\s+', ' ', 'g')) AS stripped FROM pages")
def markdown_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.markdown_strip("html").alias("stripped"))


FILES = r"""files AS (SELECT doc_id AS path, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'lead ' || doc_id || chr(10) || '## One' || chr(10) || text ELSE '## A' || chr(10) || text || chr(10) || '## B' || chr(10) || text END AS text FROM documents)"""


def sample_files(spark, sf_dir):
    n, t = F.col("doc_id"), F.col("text")
    text = F.when(n % 3 == 0, t).when(n % 3 == 1, F.concat(F.lit("lead "), n, F.lit("\n## One\n"), t)).otherwise(F.concat(F.lit("## A\n"), t, F.lit("\n## B\n"), t))
    return table(spark, sf_dir, "documents").select(n.alias("path"), text.alias("text"))


@query(rf"""WITH {FILES}, parts AS (SELECT path, string_split_regex(text, '(?m)^##\s+') AS ps FROM files), each AS (SELECT path, len(ps) AS n, unnest(range(0, len(ps))) AS section_no, unnest(ps) AS part FROM parts),
named AS (SELECT path, section_no, n, CASE WHEN n = 1 THEN 'body' WHEN section_no = 0 THEN 'preamble' ELSE regexp_replace(string_split(part, chr(10))[1], '^\s+|\s+$', '', 'g') END AS name, regexp_replace(CASE WHEN section_no = 0 THEN part WHEN instr(part, chr(10)) = 0 THEN '' ELSE part[instr(part, chr(10)) + 1:] END, '^\s+|\s+$', '', 'g') AS body FROM each)
SELECT path, section_no::INT AS section_no, name, body FROM named WHERE n = 1 OR section_no > 0 OR body <> ''""")
def chunk_h2(spark, sf_dir):
    return chunk.h2_sections(sample_files(spark, sf_dir))


@query()
def chunk_markdown(spark, sf_dir):
    return chunk.chunked(sample_files(spark, sf_dir).withColumn("path", F.col("path").cast("string")))


@query(rf"""WITH {E}, n AS (SELECT id, coalesce(value, '') AS t, length(coalesce(value, '')) AS n, sha256(hash) AS h FROM entries), d AS (SELECT *, CASE WHEN n > 200 THEN (('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UBIGINT % (n - 199)::UBIGINT)::BIGINT END AS drawn FROM n),
f AS (SELECT *, drawn + instr(t[drawn + 1:drawn + 200], ' ') AS start FROM d), w AS (SELECT *, t[start + 1:start + 200] AS piece FROM f), k AS (SELECT *, CASE WHEN contains(piece, ' ') AND length(regexp_extract(piece, '(?s)^(.*) ', 1)) > 0 THEN regexp_extract(piece, '(?s)^(.*) ', 1) ELSE piece END AS cut FROM w)
SELECT id, CASE WHEN n <= 200 THEN t ELSE CASE WHEN start > 0 THEN '… ' ELSE '' END || regexp_replace(cut, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') || CASE WHEN start + length(cut) < n THEN ' …' ELSE '' END END AS snippet FROM k""")
def snippet_fallback(spark, sf_dir):
    return snippets.with_excerpt(sample_entries(spark, sf_dir).select("id", "hash", "value")).select("id", "snippet")


@query("SELECT vec_id, (4 * len(embedding))::INT AS n_bytes, true AS same FROM embeddings")
def blob_roundtrip(spark, sf_dir):
    from lorekeep.functions.blobs import from_blob, to_blob

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", to_blob("embedding").alias("blob"))
    return rows.select("vec_id", F.length("blob").alias("n_bytes"), (from_blob("blob") == F.col("embedding")).alias("same"))
