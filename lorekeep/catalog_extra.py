"""Further queries of the engine: upkeep, settings, files, watches and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.catalog import CTX, NOW, E, query, sample_entries, table
from lorekeep.catalog_more import FEATURES, PROJECTS, QUEUE, file_events, sample_files, sample_queue, scored_rows
from lorekeep.functions import text as tx
from lorekeep.operators import chunk, lifecycle, promotion
from lorekeep.sources import files
from lorekeep.streaming import events as ev

# Upkeep

FIRST = "(SELECT min(hash) FROM entries WHERE scope = 'project' AND project_id = 'p3')"


def first_hash(entries) -> str:
    """Some row's hash, as a caller would name one."""
    return entries.filter("scope = 'project' AND project_id = 'p3'").agg(F.min("hash")).first()[0]


@query(f"""WITH {E}, k AS (SELECT *, {CTX} AS ctx FROM entries WHERE NOT (project_id = 'p3' AND hash = {FIRST})) SELECT id, (row_number() OVER (PARTITION BY ctx, source_file ORDER BY id) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY ctx, source_file))::INT AS total_chunks, false AS is_stone FROM k
UNION ALL SELECT DISTINCT NULL, NULL, NULL, true FROM entries WHERE project_id = 'p3' AND hash = {FIRST} AND scope IS NOT NULL""")
def delete_hash(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    left, stones = lifecycle.delete_hash(entries, "p3", first_hash(entries) or "", NOW)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return left.select("id", "chunk_index", "total_chunks", F.lit(False).alias("is_stone")).unionByName(stones.select(none("long", "id"), none("int", "chunk_index"), none("int", "total_chunks"), F.lit(True).alias("is_stone")))


@query(f"WITH {E} SELECT id, CASE WHEN project_id = 'p3' AND hash = {FIRST} THEN 2.5 ELSE ttl_days END::DOUBLE AS ttl_days FROM entries")
def set_ttl(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    return lifecycle.set_ttl(entries, "p3", first_hash(entries) or "", 2.5).select("id", "ttl_days")


@query(f"WITH {E} SELECT id FROM entries WHERE {CTX} <> 'custom:2:p1:notes'")
def delete_context(spark, sf_dir):
    return lifecycle.delete_context(sample_entries(spark, sf_dir), "custom:2:p1:notes").select("id")


@query(f"WITH {E} SELECT id, path FROM entries WHERE hash = {FIRST} AND project_id = 'p3' ORDER BY id LIMIT 1")
def entry_lookup(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    return lifecycle.lookup(entries, "hash", first_hash(entries) or "", "p3").select("id", "path")


@query(f"WITH {E}, s AS (SELECT DISTINCT workspace_id, project_id FROM entries WHERE workspace_id IS NOT NULL) SELECT id, workspace_id IS NOT NULL AND workspace_id = 'w1' AS refused FROM entries")
def workspace_guard(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    spaces = entries.filter("workspace_id IS NOT NULL").select(F.col("workspace_id").alias("id"), "project_id", F.when(F.col("workspace_id") == "w1", "Closed").otherwise("Active").alias("status")).distinct()
    return lifecycle.writable(entries.select("id", "workspace_id", "project_id"), spaces).select("id", "refused")


@query(f"WITH {E} SELECT id FROM entries WHERE NOT (workspace_id IS NOT DISTINCT FROM 'w2' AND project_id = 'p2')")
def workspace_discard(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    spaces = spark.createDataFrame([("w2", "p2", "Active", None)], "id string, project_id string, status string, closed_at long")
    return lifecycle.discard_workspace(entries, spaces, "p2", "w2", NOW)[0].select("id")


@query(f"WITH {QUEUE} SELECT project_id, hash, project_id = 'p1' AS gone FROM queue")
def queue_discard(spark, sf_dir):
    left, gone = promotion.discarded(sample_queue(spark, sf_dir), "p1")
    return left.select("project_id", "hash", F.lit(False).alias("gone")).unionByName(gone.select("project_id", "hash", F.lit(True).alias("gone")))


SIGNS = "CASE r " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in promotion.SIGNS.items()) + " ELSE 0 END"


@query(f"WITH {FEATURES}, e AS (SELECT id, unnest(string_split(reasons, ',')) AS r FROM done) SELECT id, sum({SIGNS})::INT AS sign_score FROM e GROUP BY id")
def sign_score(spark, sf_dir):
    return promotion.sign_score(promotion.scored(scored_rows(spark, sf_dir), PROJECTS)).select("id", "sign_score")


@query(f"WITH {E} SELECT id, CASE WHEN workspace_id IS NOT NULL THEN 'workspace:' || workspace_id WHEN scope = 'shared' THEN 'shared' WHEN scope = 'project' THEN 'project:' || project_id ELSE 'label:' || project_id || ':' || coalesce(context_label, '') END AS context FROM entries")
def context_names(spark, sf_dir):
    return sample_entries(spark, sf_dir).select("id", tx.context_name().alias("context"))


# Settings

PREFIXES = ("ingest.scope.", "ingest.new.", "watch.gate.p", "watch.on.p")
_KEYS = f"""kv AS (SELECT key, arg_max(value, event_id) AS value FROM (SELECT event_id, {list(PREFIXES)}[1 + user_id % 4] || (user_id // 4 % 60) AS key,
  CASE event_id % 5 WHEN 0 THEN ' ' || (event_id % 23) || ' ' WHEN 1 THEN event_type WHEN 2 THEN 'TRUE' WHEN 3 THEN 'False ' ELSE (event_id % 40)::VARCHAR END AS value FROM events) GROUP BY key)"""


def settings(spark, sf_dir):
    """Settings (key, value) that events have left: the last value of each key, well formed or not."""
    e, n = F.col("event_id"), F.col("event_id") % 5
    key = F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("user_id") % 4 + 1).cast("int")), F.expr("user_id DIV 4 % 60"))
    value = F.when(n == 0, F.concat(F.lit(" "), e % 23, F.lit(" "))).when(n == 1, F.col("event_type")).when(n == 2, "TRUE").when(n == 3, "False ").otherwise((e % 40).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"), value.alias("value")).groupBy("key").agg(F.max_by("value", "event_id").alias("value"))


@query(f"WITH {_KEYS} SELECT key, value FROM kv WHERE NOT starts_with(key, 'ingest.scope.') UNION ALL SELECT 'ingest.new.' || key[14:], value FROM kv WHERE starts_with(key, 'ingest.scope.') AND 'ingest.new.' || key[14:] NOT IN (SELECT key FROM kv)")
def scope_migration(spark, sf_dir):
    return files.moved_scopes(settings(spark, sf_dir), "ingest.scope.", "ingest.new.")


@query(f"WITH {_KEYS} SELECT key, CASE WHEN try_cast(trim(value) AS INT) BETWEEN 1 AND 16 THEN try_cast(trim(value) AS INT) ELSE 4 END AS n, CASE WHEN lower(trim(value)) IN ('true', 'false') THEN lower(trim(value)) = 'true' ELSE false END AS b FROM kv")
def settings_parse(spark, sf_dir):
    return settings(spark, sf_dir).select("key", tx.parsed("value", "int", 4, 1, 16).alias("n"), tx.parsed("value", "boolean", False).alias("b"))


@query(f"WITH {_KEYS}, new AS (SELECT DISTINCT 'watch.gate.p' || (user_id % 4) AS key, 'v' || (user_id % 4) AS value FROM events) SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM kv o FULL JOIN new n USING (key)")
def settings_upsert(spark, sf_dir):
    n = F.col("user_id") % 4
    new = table(spark, sf_dir, "events").select(F.concat(F.lit("watch.gate.p"), n).alias("key"), F.concat(F.lit("v"), n).alias("value")).distinct()
    return lifecycle.upsert(settings(spark, sf_dir), new, "key")


@query("SELECT event_type, to_json(list_sort(list_distinct(list('d' || (user_id % 20)))))::VARCHAR AS scopes FROM events GROUP BY event_type")
def scope_list(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.collect_set(F.concat(F.lit("d"), F.col("user_id") % 20)).alias("paths"))
    return rows.select("event_type", tx.as_json_list(tx.scopes("paths")).alias("scopes"))


# Files and watches

PAGES = "pg AS (SELECT page_id, ['docs/adr/', 'docs/', '.claude/skills/', 'src/', ''][page_id % 5 + 1] || 'a' || (page_id % 7) || '/p' || page_id || ['.md', '.txt', '.cs'][page_id % 3 + 1] AS path FROM pages)"


def page_paths(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    path = F.concat(pick(("docs/adr/", "docs/", ".claude/skills/", "src/", "")), F.lit("a"), F.col("page_id") % 7, F.lit("/p"), "page_id", pick((".md", ".txt", ".cs")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


RULES = [("docs/adr/", "adr", "decisions"), ("docs/", "doc", "docs"), (".claude/skills/", "skill", None)]


@query(f"WITH {PAGES} SELECT page_id, CASE WHEN starts_with(path, 'docs/adr/') THEN 'adr' WHEN starts_with(path, 'docs/') THEN 'doc' WHEN starts_with(path, '.claude/skills/') THEN 'skill' ELSE 'note' END AS kind, CASE WHEN starts_with(path, 'docs/adr/') THEN 'decisions' WHEN starts_with(path, 'docs/') THEN 'docs' END AS context_label FROM pg WHERE ends_with(path, '.md') AND NOT starts_with(path, 'src/')")
def classify_paths(spark, sf_dir):
    return files.classified(files.globbed(page_paths(spark, sf_dir), ["*.md"], ["src/*"]), RULES, ("note", None)).select("page_id", "kind", "context_label")


@query(f"WITH {PAGES}, s AS (SELECT string_split(path, '/') AS p FROM pg), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM s) SELECT array_to_string(p[1:k - 1], '/') AS parent, p[k] AS name, bool_or(k < len(p)) AS is_folder FROM n GROUP BY ALL")
def file_tree(spark, sf_dir):
    return files.tree(page_paths(spark, sf_dir))


@query()
def file_tree_json(spark, sf_dir):
    """One nested object for each project; a page belongs to the project of its number."""
    return files.tree_json(page_paths(spark, sf_dir).withColumn("project_id", F.concat(F.lit("p"), F.col("page_id") % 5)))


LISTED = "f AS (SELECT 'docs/' || doc_id || '.md' AS path, n_chars AS mtime, lang FROM documents), known AS (SELECT path FROM f WHERE lang = 'en')"


def listed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.col("n_chars").alias("mtime"), "lang")


@query(f"WITH {LISTED} SELECT path FROM f WHERE mtime > 900 OR (mtime <= 900 AND path NOT IN (SELECT path FROM known))")
def due_files(spark, sf_dir):
    rows = listed(spark, sf_dir)
    return files.due(rows, rows.filter("lang = 'en'"), 900).select("path")


@query(f"WITH {LISTED} SELECT path FROM known WHERE path NOT IN (SELECT path FROM f WHERE mtime > 900)")
def vanished_files(spark, sf_dir):
    rows = listed(spark, sf_dir)
    return files.vanished(rows.filter("lang = 'en'").select("path"), rows.filter("mtime > 900"), "docs")


SNAPS = "a AS (SELECT lang AS project_id, 'f' || doc_id AS path, n_chars AS mtime, md5(text) AS hash FROM documents WHERE source <> 'src1'), b AS (SELECT lang AS project_id, CASE WHEN source = 'src2' THEN 'moved/' ELSE '' END || 'f' || doc_id AS path, n_chars AS mtime, CASE WHEN source = 'src3' THEN 'new' ELSE md5(text) END AS hash FROM documents WHERE source <> 'src4')"


@query(f"""WITH {SNAPS}, k AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.path, b.path) AS path, a.hash AS was, b.hash AS now, a.path IS NULL AS is_new, b.path IS NULL AS is_gone FROM a FULL JOIN b ON a.project_id = b.project_id AND a.path = b.path),
d AS (SELECT project_id, was AS hash, min(path) AS old_path FROM k WHERE is_gone GROUP BY ALL HAVING count(*) = 1), c AS (SELECT project_id, now AS hash, min(path) AS path FROM k WHERE is_new GROUP BY ALL HAVING count(*) = 1), r AS (SELECT project_id, path, old_path FROM d JOIN c USING (project_id, hash))
SELECT project_id, path, 'Renamed' AS kind, old_path FROM r UNION ALL SELECT project_id, path, CASE WHEN is_new THEN 'Created' WHEN is_gone THEN 'Deleted' ELSE 'Changed' END, NULL FROM k WHERE (is_new OR is_gone OR was <> now) AND (project_id, path) NOT IN (SELECT (project_id, path) FROM r) AND (project_id, path) NOT IN (SELECT (project_id, old_path) FROM r)""")
def file_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("project_id"), F.concat(F.lit("f"), "doc_id").alias("path"), F.col("n_chars").alias("mtime"), F.md5("text").alias("hash"), "source")
    after = docs.filter("source <> 'src4'").withColumns({"path": F.concat(F.when(F.col("source") == "src2", "moved/").otherwise(""), "path"), "hash": F.when(F.col("source") == "src3", "new").otherwise(F.col("hash"))})
    return ev.changes(docs.filter("source <> 'src1'"), after)


RESULTS = "r AS (SELECT event_type AS project_id, (user_id % 50)::VARCHAR AS watch_path, event_id AS seq, event_id % 5 = 0 AS ok, event_id * 10 AS at_, 'e' || event_id AS error FROM events)"


def results(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), (F.col("user_id") % 50).cast("string").alias("watch_path"), n.alias("seq"), (n % 5 == 0).alias("ok"), (n * 10).alias("at"), F.concat(F.lit("e"), n).alias("error"))


@query(f"""WITH {RESULTS}, s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY project_id, watch_path ORDER BY seq) AS spell FROM r), t AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY project_id, watch_path, spell ORDER BY seq) AS run FROM s),
u AS (SELECT project_id, watch_path, max(run) >= 5 AS stopped, arg_max(run, seq) AS run, arg_max(ok, seq) AS ok, arg_max(error, CASE WHEN NOT ok THEN seq END) AS last_error, max(CASE WHEN ok THEN at_ END) AS last_sync FROM t GROUP BY ALL),
w AS (SELECT DISTINCT event_type AS project_id, unnest(['0', '7', 'none']) AS path FROM events)
SELECT w.project_id, w.path, CASE WHEN u.project_id IS NULL THEN 'Scanning' WHEN stopped THEN 'Stopped' WHEN ok THEN 'Healthy' ELSE 'Retrying' END AS status, (CASE WHEN u.project_id IS NULL THEN 0 WHEN stopped THEN 5 ELSE run END)::INT AS failures, last_error, last_sync FROM w LEFT JOIN u ON u.project_id = w.project_id AND u.watch_path = w.path""")
def watch_listing(spark, sf_dir):
    watches = table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), F.explode(F.array(*map(F.lit, ("0", "7", "none")))).alias("path")).distinct()
    return ev.watch_listing(watches, ev.watch_status(results(spark, sf_dir)))


@query("WITH fe AS (SELECT event_id AS seq, event_type AS project_id, 'root/' || (user_id % 10) AS watch_path FROM events), w AS (SELECT DISTINCT event_type AS project_id, unnest(['root/1', 'root/x']) AS path FROM events) SELECT w.project_id, w.path, CASE WHEN EXISTS (FROM fe WHERE fe.project_id = w.project_id AND fe.watch_path = w.path) THEN 77 ELSE 0 END::BIGINT AS last_change_ts FROM w")
def watermark_advance(spark, sf_dir):
    watches = table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), F.explode(F.array(F.lit("root/1"), F.lit("root/x"))).alias("path"), F.lit(0).cast("long").alias("last_change_ts")).distinct()
    digested = file_events(spark, sf_dir).select("project_id", F.substring("path", 1, 6).alias("watch_path"))
    return ev.advanced(watches, digested, 77)


@query("WITH j AS (SELECT event_type AS project_id, (user_id % 9)::VARCHAR AS watch_path, event_id AS seq FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, watch_path ORDER BY seq) AS round, min(seq) OVER (PARTITION BY project_id, watch_path) AS turn FROM j), p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY round, turn) AS place FROM r), g AS (SELECT min(event_type) AS project_id, 40 AS gate FROM events) SELECT p.project_id, watch_path, seq FROM p LEFT JOIN g USING (project_id) WHERE place <= least(16, greatest(1, coalesce(gate, 4))) - CASE WHEN gate IS NULL THEN 1 ELSE 0 END")
def watch_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    jobs = ev.fair_order(rows.select(F.col("event_type").alias("project_id"), (F.col("user_id") % 9).cast("string").alias("watch_path"), F.col("event_id").alias("seq")))
    gates = rows.agg(F.min("event_type").alias("project_id")).withColumn("gate", F.lit(40))
    busy = rows.select(F.col("event_type").alias("project_id")).distinct().join(gates, "project_id", "left_anti").withColumn("n", F.lit(1))
    return ev.admitted(jobs, busy, gates).select("project_id", "watch_path", "seq")


@query("WITH a AS (SELECT DISTINCT event_type AS project_id, (user_id % 11)::VARCHAR AS path FROM events WHERE user_id % 2 = 0), b AS (SELECT DISTINCT event_type AS project_id, (user_id % 11)::VARCHAR AS path FROM events WHERE user_id % 3 = 0) SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'start' WHEN a.path IS NULL THEN 'stop' ELSE 'keep' END AS action FROM a FULL JOIN b ON a.project_id = b.project_id AND a.path = b.path")
def watch_reconcile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("project_id"), (F.col("user_id") % 11).cast("string").alias("path"), "user_id")
    return ev.reconciled(rows.filter("user_id % 2 = 0"), rows.filter("user_id % 3 = 0"))


# Text


@query(r"""WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), 1) AS k FROM documents),
c AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS total FROM s) SELECT doc_id, string_agg(s, ' ' ORDER BY k) AS excerpt FROM c WHERE k = 1 OR total <= 160 GROUP BY doc_id""")
def sentence_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sentences("text", 160).alias("excerpt")).filter("excerpt <> ''")


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(regexp_extract(text, '(?m)^#{1,6}[ \t]+(.+)$', 1)) ELSE 'A title' END AS heading FROM documents")
def first_heading(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("lead\n## A title\n# B\n"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_heading(text).alias("heading"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, pow(2, event_id % 5)::BIGINT AS backoff FROM events")
def epoch_and_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.epoch(tx.moment(tx.epoch("ts"))).alias("seconds"), tx.backoff_seconds(F.col("event_id") % 5 + 1).alias("backoff"))


@query()
def chunk_kinds(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("adr", "doc", "note", "skill", "remember", "odd"))), (F.length("text") % 6 + 1).cast("int"))
    return chunk.by_kind(sample_files(spark, sf_dir).withColumn("kind", kinds).withColumn("path", F.col("path").cast("string")))


@query()
def ingest_chunks(spark, sf_dir):
    bucket = {"scope": "project", "project_id": "p1"}
    new = chunk.ingested(sample_files(spark, sf_dir).withColumn("path", F.concat(F.lit("docs/"), "path", F.lit(".md"))), bucket, NOW)
    return lifecycle.insert_chunks(sample_entries(spark, sf_dir), new).select("path", "hash", "chunk_index", "embed_state")
