"""The engine's queries over the driver's tables, each with its DuckDB SQL where SQL can say it.

Entries are made from documents and embeddings (sources.bank.sample_entries); search texts are the benchmark's items as a whole and TEXTS,
query vectors the embeddings with their numbers. The keyword index is a kept table, made when it is first asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import evaluate, fusion, index, keyword, lifecycle, vector
from lorekeep.plans import planner, search
from lorekeep.sources.bank import sample_entries, violations
from lorekeep.sources.tables import kept_path, stash
from lorekeep.streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1707955200
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def added(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return added


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Common table expressions of the SQL side

E = """entries AS (SELECT d.doc_id AS id, sha256('docs/' || (d.doc_id // 8) || '.md' || d.text) AS hash, 'docs/' || (d.doc_id // 8) || '.md' AS path, d.text AS value,
  'docs/' || (d.doc_id // 8) || '.md' AS source_file, d.lang AS section, CASE WHEN d.doc_id // 8 % 7 = 0 THEN 'shared' WHEN d.doc_id // 8 % 7 = 1 THEN 'custom' WHEN d.doc_id // 8 % 7 > 2 THEN 'project' END AS scope,
  'p' || (d.doc_id // 8 % 5) AS project_id, CASE WHEN d.doc_id // 8 % 7 = 1 THEN 'notes' END AS context_label, CASE WHEN d.doc_id // 8 % 7 = 2 THEN 'w' || (d.doc_id // 8 % 5) END AS workspace_id,
  1704067200 + d.doc_id * 3600 AS created_at, d.doc_id % 7 AS access_count, CASE WHEN d.doc_id % 3 = 0 THEN 10.0 END AS ttl_days, 0.1::DOUBLE + (d.doc_id % 9) / 10.0::DOUBLE AS rating, e.embedding,
  CASE WHEN e.embedding IS NULL THEN 'pending' ELSE 'embedded' END AS embed_state, (d.doc_id % 8)::INT AS chunk_index
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
CTX = "CASE WHEN workspace_id IS NOT NULL THEN 'workspace:' || length(project_id) || ':' || project_id || ':' || workspace_id WHEN scope = 'shared' THEN 'shared' WHEN scope = 'project' THEN 'project:' || project_id ELSE 'custom:' || length(project_id) || ':' || project_id || ':' || coalesce(context_label, '') END"
TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
STOP = ", ".join(f"'{w}'" for w in planner.STOPWORDS)
RESERVED = ", ".join(f"'{w}'" for w in planner.RESERVED)


def _tokens(column: str) -> str:
    return TOKENS.format(column)


def bm25_sql(terms: str, phrases: bool = False, weights: dict[str, float] = keyword.WEIGHTS, tag: str = "") -> str:
    """CTEs ending in hits<tag>(query_id, id, score, n_terms) for rows (query_id, term), given by a query. phrases: terms may have several tokens."""
    each = " UNION ALL ".join(f"SELECT id, '{c}' AS c, {w}::DOUBLE AS w, {_tokens(c)} AS t FROM entries" for c, w in weights.items())
    if phrases:
        found = f"""tok{tag} AS (SELECT id, c, w, unnest(t) AS token, unnest(range(len(t))) AS i FROM ({each})), ph{tag} AS (SELECT term, unnest(string_split(term, ' ')) AS token, unnest(range(len(string_split(term, ' ')))) AS k, len(string_split(term, ' ')) AS size FROM (SELECT DISTINCT term FROM terms{tag})),
tf{tag} AS (SELECT id, term, sum(w) AS f FROM (SELECT term, id, w FROM ph{tag} JOIN tok{tag} USING (token) GROUP BY term, id, c, w, size, i - k HAVING count(*) = size) GROUP BY ALL)"""
    else:
        found = f"tf{tag} AS (SELECT id, term, sum(w) AS f FROM (SELECT id, w, unnest(t) AS term FROM ({each})) WHERE term IN (SELECT term FROM terms{tag}) GROUP BY ALL)"
    lengths = " + ".join(f"len({_tokens(c)})" for c in keyword.WEIGHTS)
    return f"""terms{tag} AS ({terms}), {found},
lens{tag} AS (SELECT id, {lengths} AS d FROM entries), stats{tag} AS (SELECT count(*) AS n, avg(d) AS mean FROM lens{tag}), dfs{tag} AS (SELECT term, count(*) AS df FROM tf{tag} GROUP BY term),
parts{tag} AS (SELECT t.id, t.term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * d / mean)) AS part
  FROM tf{tag} t JOIN dfs{tag} USING (term) JOIN lens{tag} USING (id), stats{tag}),
hits{tag} AS (SELECT query_id, id, sum(part) AS score, count(DISTINCT term) AS n_terms FROM terms{tag} JOIN parts{tag} USING (term) GROUP BY query_id, id)"""


#: Short search texts beside the benchmark's long ones, so that every kind of plan occurs. Their query ids count down from -1.
TEXTS = ["thble thtion", "Thing, the attion", "erble", "the and of", "anea AND thanedble ertion", "ering oning onble ontion", "thtion the thing or erble attion of ertion", "docs/3.md", " docs/5.md#en", "docs/2.MD#fr", "notes/none.txt"]
_PATH_SQL = r"^([A-Za-z0-9_./-]+\.(?i:md|markdown|txt))(?:#([A-Za-z0-9_-]+))?$"

Q = "q AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-n}, '{t}')" for n, t in enumerate(TEXTS, 1)) + f""") v(query_id, text)),
c AS (SELECT *, list_filter(raw, lambda t: t NOT IN ({STOP})) AS content FROM (SELECT query_id, regexp_extract(trim(text), '{_PATH_SQL}', 1) AS file, regexp_extract(trim(text), '{_PATH_SQL}', 2) AS sect, list_filter({_tokens('text')}, lambda t: t NOT IN ({RESERVED})) AS raw FROM q))"""
PLANS = f"""{Q}, plans AS (SELECT query_id, file <> '' AS is_path, sect <> '' AS has_section, CASE WHEN file <> '' THEN {_tokens('file')} || CASE WHEN sect <> '' THEN [array_to_string({_tokens('sect')}, ' ')] ELSE [] END WHEN len(content) BETWEEN 1 AND 4 THEN content ELSE [] END AS every,
  CASE WHEN file = '' AND len(content) > 4 THEN raw ELSE [] END AS some_terms, CASE WHEN file = '' AND len(content) BETWEEN 2 AND 4 THEN raw || CASE WHEN len(content) > 2 THEN list_transform(range(1, len(content)), lambda i: content[i] || ' ' || content[i + 1]) ELSE [] END ELSE [] END AS fallback,
  CASE WHEN file <> '' THEN len({_tokens('file')}) + (sect <> '')::INT ELSE len(content) END AS n_content FROM c)"""
RAW = "SELECT query_id, unnest(raw) AS term FROM c"
STRICT = "SELECT query_id, unnest(every) AS term FROM plans WHERE NOT is_path"
LOOSE = "SELECT query_id, unnest(CASE WHEN len(every) > 0 THEN fallback ELSE some_terms END) AS term FROM plans WHERE NOT is_path"


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): every benchmark item as a whole, and TEXTS."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.unionByName(spark.createDataFrame([(-n, t) for n, t in enumerate(TEXTS, 1)], "query_id long, text string"))


def raw_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, terms): all tokens of each search text but reserved words."""
    return search_texts(spark, sf_dir).select("query_id", planner.raw_terms(tx.tokens("text")).alias("terms"))


def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = search_texts(spark, sf_dir).select("query_id", F.abs("query_id").alias("vec_id"))
    return numbered.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("query_id", "vector")


def with_ctx(entries: DataFrame) -> DataFrame:
    return entries.withColumn("ctx", tx.context_key())


def keyword_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The kept index of the entries, found again by later applications with the same spark.checkpoint.dir."""
    path = kept_path(spark, f"keyword index {index.FORMAT}", table(spark, sf_dir, "documents"))
    return index.read(spark, path) or index.build(with_ctx(sample_entries(spark, sf_dir)), path)


# Identity and model


@query("SELECT doc_id AS id, sha256(sha256(text) || '.md' || text) AS hash, sha256(text) || '.md' AS path FROM documents")
def content_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", tx.written_path("text").alias("path"))
    return rows.select("id", tx.content_hash("path", "text").alias("hash"), "path")


@query(f"WITH {E} SELECT {CTX} AS ctx, count(*) AS n FROM entries GROUP BY ALL")
def context_key(spark, sf_dir):
    return with_ctx(sample_entries(spark, sf_dir)).groupBy("ctx").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT id, hash FROM entries WHERE {CTX} = 'custom:2:p1:notes'")
def context_filter(spark, sf_dir):
    return sample_entries(spark, sf_dir).filter(tx.context_key() == planner.context_key_for("label:p1:notes", "p1")).select("id", "hash")


@query(f"WITH {E} SELECT id, hash, path, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM entries WHERE scope = 'project' AND project_id = 'p1' QUALIFY place <= 50")
def context_listing(spark, sf_dir):
    rows = sample_entries(spark, sf_dir).filter("scope = 'project' AND project_id = 'p1'").orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))).select("id", "hash", "path", "place")


@query(f"WITH {E} SELECT DISTINCT scope, CASE WHEN scope = 'shared' THEN NULL ELSE project_id END AS project_id, context_label, CASE WHEN scope = 'shared' THEN 0 ELSE 1 END AS after_shared FROM entries WHERE scope IS NOT NULL")
def committed_contexts(spark, sf_dir):
    shared = F.col("scope") == "shared"
    return sample_entries(spark, sf_dir).filter("scope IS NOT NULL").select("scope", F.when(~shared, F.col("project_id")).alias("project_id"), "context_label", F.when(shared, 0).otherwise(1).alias("after_shared")).distinct().orderBy("after_shared", "project_id", "context_label")


@query(f"WITH {E} SELECT DISTINCT path FROM entries WHERE scope IS NOT NULL")
def file_paths(spark, sf_dir):
    return sample_entries(spark, sf_dir).filter("scope IS NOT NULL").select("path").distinct()


@query(f"WITH {E} SELECT project_id, count(*) AS n_entries, count(*) FILTER (embed_state = 'pending') AS n_pending FROM entries GROUP BY ALL")
def bank_stats(spark, sf_dir):
    return lifecycle.stats(sample_entries(spark, sf_dir))


SETTINGS = [("watch.concurrency.global", "8"), ("watch.concurrency.project:p1", "2"), ("watch.enabled.project:p3", "true"), ("sweep.threshold", "0.3")]


@query(f"WITH {E}, p AS (SELECT DISTINCT project_id FROM entries) SELECT project_id, CASE WHEN project_id = 'p1' THEN '2' ELSE '8' END AS concurrency, CASE WHEN project_id = 'p3' THEN 'true' ELSE 'false' END AS enabled FROM p")
def config_resolve(spark, sf_dir):
    settings = spark.createDataFrame(SETTINGS, "key string, value string")
    projects = sample_entries(spark, sf_dir).select("project_id").distinct()
    own = lambda name, default: ev.resolved_settings(settings, projects, name, default)
    return own("watch.concurrency", "4").withColumnRenamed("value", "concurrency").join(own("watch.enabled", "false").withColumnRenamed("value", "enabled"), "project_id")


@query(f"""WITH {E}, bad AS (SELECT id, scope, workspace_id, embed_state FROM entries UNION ALL SELECT -id - 1, CASE WHEN workspace_id IS NOT NULL THEN 'project' WHEN scope = 'custom' THEN 'odd' END, workspace_id, CASE WHEN scope = 'shared' THEN 'lost' ELSE embed_state END FROM entries)
SELECT id, 'workspace xor scope' AS rule FROM bad WHERE (workspace_id IS NULL) = (scope IS NULL) UNION ALL SELECT id, 'scope' FROM bad WHERE scope NOT IN ('shared', 'project', 'custom')
UNION ALL SELECT id, 'embed_state' FROM bad WHERE embed_state NOT IN ('pending', 'embedded') UNION ALL SELECT id, 'workspace missing' FROM bad WHERE workspace_id NOT IN ('w0', 'w1', 'w2', 'w3')""")
def constraint_check(spark, sf_dir):
    entries = sample_entries(spark, sf_dir).select("id", "scope", "workspace_id", "embed_state")
    broken = entries.select((-F.col("id") - 1).alias("id"), F.when(F.col("workspace_id").isNotNull(), "project").when(F.col("scope") == "custom", "odd").alias("scope"), "workspace_id", F.when(F.col("scope") == "shared", "lost").otherwise(F.col("embed_state")).alias("embed_state"))
    return violations(entries.unionByName(broken), spark.createDataFrame([(f"w{n}",) for n in range(4)], "id string"))


# Writes


@query(f"""WITH {E}, held AS (SELECT project_id, value, min(id) AS existing_id FROM entries WHERE scope IS NOT NULL GROUP BY ALL),
r AS (SELECT id AS request_id, project_id, value FROM entries UNION ALL SELECT -conv_id * 1000 - turn - 1, 'p' || conv_id % 5, text FROM conversations), m AS (SELECT r.*, existing_id, row_number() OVER (PARTITION BY r.project_id, r.value ORDER BY request_id) AS turn FROM r LEFT JOIN held USING (project_id, value))
SELECT request_id, project_id, sha256(value) || '.md' AS path, sha256(sha256(value) || '.md' || value) AS hash, existing_id, existing_id IS NULL AND turn = 1 AS inserts FROM m""")
def write_dedup(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("request_id"), F.concat(F.lit("p"), F.col("conv_id") % 5).alias("project_id"), F.col("text").alias("value"))
    requests = entries.select(F.col("id").alias("request_id"), "project_id", "value").unionByName(said)
    return lifecycle.write(entries, requests).select("request_id", "project_id", "path", "hash", "existing_id", "inserts")


@query(f"WITH {E}, b AS (SELECT id, section || '.md' AS path, sha256(section || '.md' || value) AS hash FROM entries) SELECT min(id) AS id, path, hash FROM b GROUP BY path, hash")
def bucket_dedupe(spark, sf_dir):
    path = F.concat("section", F.lit(".md"))
    rows = sample_entries(spark, sf_dir).select("id", path.alias("path"), tx.content_hash(path, "value").alias("hash"), F.lit("shared").alias("scope"), "project_id", F.lit(None).cast("string").alias("context_label"), F.lit(None).cast("string").alias("workspace_id"))
    return lifecycle.first_of_bucket(rows).select("id", "path", "hash")


@query(f"WITH {E}, k AS (SELECT *, {CTX} AS ctx FROM entries) SELECT id, ctx, (row_number() OVER (PARTITION BY ctx, source_file ORDER BY id) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY ctx, source_file))::INT AS total_chunks FROM k")
def chunk_numbering(spark, sf_dir):
    return lifecycle.numbered(sample_entries(spark, sf_dir)).select("id", "ctx", "chunk_index", "total_chunks")


@query(f"""WITH {E}, c AS (SELECT *, 'shared/' || path AS shared_path, row_number() OVER (PARTITION BY path ORDER BY id) AS place FROM entries WHERE scope = 'project')
SELECT id, shared_path AS path, sha256(shared_path || value) AS hash, source_file, section FROM c WHERE place = 1 AND shared_path NOT IN (SELECT path FROM entries WHERE scope = 'shared')""")
def share_promote(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    return lifecycle.share(entries, entries.filter("scope = 'project'").select("project_id", "hash")).select("id", "path", "hash", "source_file", "section")


@query(f"""WITH {E}, inside AS (SELECT * FROM entries WHERE workspace_id = 'w2' AND project_id = 'p2'),
p AS (SELECT min(id) AS id, path FROM inside WHERE path NOT IN (SELECT path FROM entries WHERE scope = 'project' AND project_id = 'p2') GROUP BY path)
SELECT id, path, true AS promoted FROM p UNION ALL SELECT id, path, false FROM inside""")
def workspace_consolidate(spark, sf_dir):
    promoted, discarded = lifecycle.consolidate_workspace(sample_entries(spark, sf_dir), "p2", "w2", ["ALL"])
    return promoted.select("id", "path", F.lit(True).alias("promoted")).unionByName(discarded.select("id", "path", F.lit(False).alias("promoted")))


@query(f"WITH {E} SELECT id FROM entries WHERE NOT (project_id = 'p3' AND scope IS NOT NULL AND (source_file = 'docs' OR starts_with(source_file, 'docs/')))")
def delete_subtree(spark, sf_dir):
    return lifecycle.delete_subtree(sample_entries(spark, sf_dir), "p3", "docs").select("id")


RATING = "0.5::DOUBLE * pow(0.5::DOUBLE, greatest(0.0, ({now} - created_at) / 86400.0::DOUBLE) / 30.0::DOUBLE) * (1 + 0.1::DOUBLE * {n})"


@query(f"WITH {E}, h AS (SELECT DISTINCT hash FROM entries WHERE project_id = 'p1') SELECT id, access_count + CASE WHEN h.hash IS NULL THEN 0 ELSE 1 END AS access_count, round(CASE WHEN h.hash IS NULL THEN rating ELSE {RATING.format(now=NOW, n='(access_count + 1)')} END, 6) AS rating FROM entries LEFT JOIN h USING (hash)")
def access_bump(spark, sf_dir):
    entries = sample_entries(spark, sf_dir)
    return lifecycle.bump_access(entries, entries.filter("project_id = 'p1'"), NOW).select("id", "access_count", F.round("rating", 6).alias("rating"))


@query(f"WITH {E} SELECT id, hash FROM entries WHERE embed_state = 'pending' ORDER BY id LIMIT 32")
def embed_pending(spark, sf_dir):
    return lifecycle.pending(sample_entries(spark, sf_dir), 32).select("id", "hash")


@query(f"WITH {E} SELECT id, round({RATING.format(now=NOW, n='access_count')}, 6) AS rating FROM entries")
def rating_decay(spark, sf_dir):
    return sample_entries(spark, sf_dir).select("id", F.round(tx.rating("created_at", "access_count", NOW), 6).alias("rating"))


@query(f"WITH {E} SELECT id, project_id FROM entries WHERE scope = 'project' AND hash NOT IN (SELECT hash FROM entries WHERE scope = 'shared') AND ttl_days IS NOT NULL AND rating < 0.3 AND greatest(0.0, ({NOW} - created_at) / 86400.0::DOUBLE) > ttl_days")
def ttl_sweep(spark, sf_dir):
    return lifecycle.sweep(sample_entries(spark, sf_dir), None, NOW).select("id", "project_id")


# Keyword search


@query(f"WITH {E}, {Q}, {bm25_sql(RAW)} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hits QUALIFY rank <= 10")
def bm25_weighted(spark, sf_dir):
    hits = keyword.any_of(raw_searches(spark, sf_dir), keyword_index(spark, sf_dir), k=10)
    return keyword.ranked(hits, 10, "query_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {E}, {Q}, {bm25_sql(RAW, weights={'value': 1.0})} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hits QUALIFY rank <= 10")
def bm25_or(spark, sf_dir):
    hits = keyword.any_of(raw_searches(spark, sf_dir), keyword_index(spark, sf_dir), {"value": 1.0}, 10)
    return keyword.ranked(hits, 10, "query_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {E}, {PLANS}, {bm25_sql(STRICT)} SELECT query_id, id, round(score, 6) AS score FROM hits JOIN plans USING (query_id) WHERE n_terms = len(list_distinct(every))")
def bm25_and(spark, sf_dir):
    asked = planner.planned(search_texts(spark, sf_dir)).filter("NOT is_path").select("query_id", F.col("every").alias("terms"))
    return keyword.all_of(asked, keyword_index(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {E}, {PLANS}, {bm25_sql(STRICT, True, tag='_s')}, {bm25_sql(LOOSE, True, tag='_l')}, s AS (SELECT h.* FROM hits_s h JOIN plans USING (query_id) WHERE n_terms = len(list_distinct(every))),
n AS (SELECT p.query_id, any_value(len(every)) > 0 AS has_every, count(s.id) <= greatest(any_value(n_content), 10) AND any_value(len(fallback)) > 0 AS fell_back FROM plans p LEFT JOIN s USING (query_id) WHERE NOT is_path GROUP BY p.query_id),
both_lists AS (SELECT query_id, id, score, false AS loose FROM s UNION ALL SELECT query_id, id, score, true FROM hits_l)
SELECT query_id, id, round(score, 6) AS score, fell_back, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM both_lists JOIN n USING (query_id) WHERE loose = (fell_back OR NOT has_every) QUALIFY rank <= 10""")
def fts_fallback(spark, sf_dir):
    plans = planner.planned(search_texts(spark, sf_dir)).filter("NOT is_path")
    hits = keyword.planned(plans, keyword_index(spark, sf_dir), 10, k=10)
    return keyword.ranked(hits, 10, "query_id").select("query_id", "id", F.round("score", 6).alias("score"), "fell_back", "rank")


PATH_HITS = f"""{bm25_sql("SELECT query_id, unnest(every) AS term FROM plans WHERE is_path AND NOT has_section", True, {"source_file": 8.0}, "_f")}, {bm25_sql("SELECT query_id, unnest(every) AS term FROM plans WHERE is_path AND has_section", True, {"source_file": 8.0, "section": 16.0}, "_g")},
path_hits AS (SELECT h.query_id, h.id, h.score FROM (SELECT * FROM hits_f UNION ALL SELECT * FROM hits_g) h JOIN plans USING (query_id) WHERE n_terms = len(list_distinct(every)))"""


@query(f"WITH {E}, {PLANS}, {PATH_HITS} SELECT query_id, id, round(score, 6) AS score FROM path_hits")
def source_path_search(spark, sf_dir):
    paths = planner.planned(search_texts(spark, sf_dir)).filter("is_path")
    return keyword.planned(paths, keyword_index(spark, sf_dir), 20).select("query_id", "id", F.round("score", 6).alias("score"))


# Vectors

KNN = "near AS (SELECT q.query_id, e.id, {keep} list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM {of} e, q JOIN embeddings v ON v.vec_id = abs(q.query_id) WHERE e.embedding IS NOT NULL)"


@query(f"WITH {E}, {Q}, {KNN.format(keep='', of='entries')} SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM near QUALIFY rank <= 10")
def knn_topk(spark, sf_dir):
    return vector.knn(sample_entries(spark, sf_dir), search_vectors(spark, sf_dir), 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


SHAPES = "shaped AS (SELECT e.* REPLACE (v.embedding AS embedding) FROM {of} e JOIN embeddings v ON v.vec_id = e.id + 7)"


def with_structure(spark: SparkSession, sf_dir: str, entries: DataFrame) -> DataFrame:
    """Entries with a structure vector: that of the seventh embedding behind their own."""
    return entries.join(table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 7).alias("id"), F.col("embedding").alias("structure_embedding")), "id", "left")


@query(f"""WITH {E}, {Q}, {KNN.format(keep='', of='entries')}, {SHAPES.format(of='entries')}, {KNN.format(keep='', of='shaped').replace('near AS', 'near2 AS')},
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS r FROM near QUALIFY r <= 100), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS r FROM near2 QUALIFY r <= 100),
f AS (SELECT query_id, id, 0.3::DOUBLE * coalesce(a.similarity, 0) + 0.7::DOUBLE * coalesce(b.similarity, 0) AS score FROM a FULL JOIN b USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def dual_vector_fusion(spark, sf_dir):
    entries, vectors = with_structure(spark, sf_dir, sample_entries(spark, sf_dir)), search_vectors(spark, sf_dir)
    both = vector.dual_fusion(vector.knn(entries, vectors, 100), vector.knn(entries.withColumn("embedding", F.col("structure_embedding")), vectors, 100), 0.3, "query_id")
    return keyword.ranked(both, 10, "query_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT vec_id, unnest(range(0, len(embedding)))::INT AS i, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 6) AS x FROM embeddings")
def vector_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.normalized(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query("WITH f AS (SELECT label, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM f GROUP BY ALL) SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m")
def vector_mean_pool(spark, sf_dir):
    return vector.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


# Fusion

LISTS = f"""{E}, {Q}, {bm25_sql(RAW)}, {KNN.format(keep='', of='entries')},
lists AS (SELECT query_id, 0 AS list_no, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hits QUALIFY rank <= 100
  UNION ALL SELECT query_id, 1, id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM near QUALIFY rank <= 100)"""


def two_lists(spark, sf_dir, size: int = 100) -> DataFrame:
    """(query_id, list_no, rank, id, path): the keyword list and the vector list over the whole bank."""
    entries = sample_entries(spark, sf_dir)
    hits = keyword.any_of(raw_searches(spark, sf_dir), keyword_index(spark, sf_dir), k=size)
    words = keyword.ranked(hits, size, "query_id").join(entries.select("id", "path"), "id").select("query_id", F.lit(0).alias("list_no"), "rank", "id", "path")
    near = vector.knn(entries, search_vectors(spark, sf_dir), size).join(entries.select("id", "path"), "id").select("query_id", F.lit(1).alias("list_no"), "rank", "id", "path")
    return words.unionByName(near)


FUSED = """fused AS (SELECT query_id, id, any_value(path) AS path, sum(CASE list_no WHEN 0 THEN {a} ELSE {b} END / ({k} + rank)) AS s FROM lists JOIN entries USING (id) GROUP BY query_id, id),
scored AS (SELECT query_id, id, path, s / max(s) OVER (PARTITION BY query_id) AS score FROM fused),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, id) AS rank FROM scored)"""


@query(f"WITH {LISTS}, {FUSED.format(a='2.0::DOUBLE', b='1.0::DOUBLE', k=60)} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    lists = two_lists(spark, sf_dir).withColumn("weight", F.when(F.col("list_no") == 0, 2.0).otherwise(1.0))
    return fusion.rrf(lists, 60, "query_id", limit=20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


POINTS = [(k, a, b) for k in evaluate.SWEEP_K for a, b in evaluate.SWEEP_WEIGHTS]


@query(f"WITH {LISTS}, g AS (SELECT * FROM (VALUES {', '.join(f'({n}, {k}, {a}::DOUBLE, {b}::DOUBLE)' for n, (k, a, b) in enumerate(POINTS))}) v(point, k, a, b)), fused AS (SELECT point, query_id, id, any_value(path) AS path, sum(CASE list_no WHEN 0 THEN a ELSE b END / (k + rank)) AS s FROM lists JOIN entries USING (id), g GROUP BY ALL), scored AS (SELECT *, s / max(s) OVER (PARTITION BY query_id, point) AS score FROM fused) SELECT point, query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, point ORDER BY round(score, 9) DESC, path, id) AS rank FROM scored QUALIFY rank <= 10")
def rrf_sweep(spark, sf_dir):
    return evaluate.rrf_sweep(two_lists(spark, sf_dir), POINTS, "query_id").filter("rank <= 10").select("point", "query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {E}, {Q}, {KNN.format(keep=f'{CTX} AS context, path,', of='entries')}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, context ORDER BY round(similarity, 9) DESC, path, id) AS r FROM near QUALIFY r <= 50),
f AS (SELECT query_id, id, any_value(path) AS path, sum(1.0::DOUBLE / (60 + r)) AS s FROM l GROUP BY query_id, id), z AS (SELECT *, s / max(s) OVER (PARTITION BY query_id) AS score FROM f)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, id) AS rank FROM z QUALIFY rank <= 20""")
def cross_context_merge(spark, sf_dir):
    lists = vector.knn(with_ctx(sample_entries(spark, sf_dir)), search_vectors(spark, sf_dir), 50, ("ctx",), ("path", "id")).withColumnRenamed("ctx", "context")
    return fusion.merge_contexts(lists, 60, "query_id").filter("rank <= 20").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


CAND = FUSED.format(a="1.0::DOUBLE", b="1.0::DOUBLE", k=60) + ", cand AS (SELECT r.query_id, r.id, r.path, r.score, e.source_file, e.chunk_index FROM ranked r JOIN entries e USING (id))"
SIBLINGS = """vis AS (SELECT *, score >= max(score) OVER (PARTITION BY query_id) - 0.1::DOUBLE AS visible FROM cand),
sib AS (SELECT a.query_id, a.id, count(b.id) AS siblings FROM cand a LEFT JOIN vis b ON a.query_id = b.query_id AND a.source_file = b.source_file AND abs(a.chunk_index - b.chunk_index) = 1 AND b.visible GROUP BY ALL)"""
BOOSTED = """boosted AS (SELECT c.*, s.siblings, c.score + 0.1::DOUBLE * s.siblings AS boosted FROM cand c JOIN sib s USING (query_id, id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 9) DESC, round(doc_score, 9) DESC, path, chunk_index, id) AS place FROM (SELECT *, max(boosted) OVER (PARTITION BY query_id, source_file) AS doc_score FROM boosted))"""
CONSOLIDATED = """best AS (SELECT *, first_value(chunk_index) OVER w AS bi, first_value(boosted) OVER w AS bs, row_number() OVER w AS n FROM placed WINDOW w AS (PARTITION BY query_id, source_file ORDER BY place)),
kept AS (SELECT * FROM best WHERE NOT (n > 1 AND abs(bi - chunk_index) = 1 AND round(bs - boosted, 9) >= 0.1)), final AS (SELECT *, boosted / max(boosted) OVER (PARTITION BY query_id) AS ranking FROM kept)"""


def candidates(spark, sf_dir) -> DataFrame:
    lists = two_lists(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return fusion.rrf(lists, 60, "query_id").drop("rank").join(sample_entries(spark, sf_dir).select("id", "source_file", "chunk_index"), "id")


@query(f"WITH {LISTS}, {CAND}, {SIBLINGS} SELECT query_id, id, siblings FROM sib")
def sibling_boost(spark, sf_dir):
    return fusion.sibling_counts(candidates(spark, sf_dir), 0.1, "query_id").select("query_id", "id", "siblings")


@query(f"WITH {LISTS}, {CAND}, {SIBLINGS}, {BOOSTED} SELECT query_id, id, round(boosted, 6) AS boosted, place FROM placed WHERE place <= 50")
def source_affinity(spark, sf_dir):
    return fusion.affinity(candidates(spark, sf_dir), 0.1, 0.1, "query_id").filter("place <= 50").select("query_id", "id", F.round("boosted", 6).alias("boosted"), "place")


@query(f"WITH {LISTS}, {CAND}, {SIBLINGS}, {BOOSTED}, {CONSOLIDATED} SELECT query_id, id, round(ranking, 6) AS ranking FROM final")
def source_consolidation(spark, sf_dir):
    boosted = fusion.affinity(candidates(spark, sf_dir), 0.1, 0.1, "query_id")
    return fusion.consolidate(boosted, 0.1, "query_id").select("query_id", "id", F.round("ranking", 6).alias("ranking"))


ASKED = ["shared", "project:p1", "workspace:2:p2:w2"]
INSIDE = ", ".join(f"'{c}'" for c in ASKED)
_TOP = "row_number() OVER (PARTITION BY query_id, ctx ORDER BY round(similarity, 9) DESC, path, id)"
HYBRID = f"""WITH {E}, ec AS (SELECT *, {CTX} AS ctx FROM entries), inside AS (SELECT * FROM ec WHERE ctx IN ({INSIDE})), {PLANS}, {bm25_sql(STRICT, True, tag='_s')}, {bm25_sql(LOOSE, True, tag='_l')}, {PATH_HITS},
s AS (SELECT h.*, ctx, path FROM hits_s h JOIN plans USING (query_id) JOIN inside USING (id) WHERE n_terms = len(list_distinct(every))), spots AS (SELECT * FROM plans, (SELECT unnest([{INSIDE}]) AS ctx) WHERE NOT is_path),
n AS (SELECT p.query_id, p.ctx, any_value(len(every)) > 0 AS has_every, count(s.id) <= greatest(any_value(n_content), 20) AND any_value(len(fallback)) > 0 AS fell_back FROM spots p LEFT JOIN s USING (query_id, ctx) GROUP BY ALL),
kw AS (SELECT query_id, ctx, path, id, score FROM s JOIN n USING (query_id, ctx) WHERE NOT fell_back UNION ALL SELECT query_id, ctx, path, id, score FROM hits_l JOIN inside USING (id) JOIN n USING (query_id, ctx) WHERE fell_back OR NOT has_every UNION ALL SELECT query_id, ctx, path, id, score FROM path_hits JOIN inside USING (id)),
{SHAPES.format(of='inside')}, {KNN.format(keep='ctx, path,', of='inside')}, {KNN.format(keep='ctx, path,', of='shaped').replace('near AS', 'near2 AS')},
va AS (SELECT *, {_TOP} AS r FROM near QUALIFY r <= 100), vb AS (SELECT *, {_TOP} AS r FROM near2 QUALIFY r <= 100),
dual AS (SELECT query_id, ctx, path, id, 0.5::DOUBLE * coalesce(va.similarity, 0) + 0.5::DOUBLE * coalesce(vb.similarity, 0) AS similarity FROM va FULL JOIN vb USING (query_id, ctx, path, id)),
lists AS (SELECT query_id, ctx, 0 AS list_no, id, path, row_number() OVER (PARTITION BY query_id, ctx ORDER BY round(score, 9) DESC, id) AS rank FROM kw QUALIFY rank <= 100 UNION ALL SELECT query_id, ctx, 1, id, path, {_TOP} AS rank FROM dual QUALIFY rank <= 100),
f1 AS (SELECT query_id, ctx, id, any_value(path) AS path, sum(1.0::DOUBLE / (60 + rank)) AS s FROM lists GROUP BY query_id, ctx, id),
f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, ctx ORDER BY round(s / m, 9) DESC, path, id) AS rank FROM (SELECT *, max(s) OVER (PARTITION BY query_id, ctx) AS m FROM f1)),
f3 AS (SELECT query_id, id, any_value(path) AS path, sum(1.0::DOUBLE / (60 + rank)) AS s FROM f2 GROUP BY query_id, id),
cand AS (SELECT x.query_id, x.id, x.path, x.s / max(x.s) OVER (PARTITION BY query_id) AS score, e.source_file, e.chunk_index, CASE WHEN is_path THEN 0.0 ELSE 0.1 END::DOUBLE AS lift FROM f3 x JOIN entries e USING (id) JOIN plans USING (query_id)), {SIBLINGS}, {BOOSTED.replace('0.1::DOUBLE * s.siblings', 'lift * s.siblings')}, {CONSOLIDATED}
SELECT query_id, id, round(ranking, 6) AS ranking, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM final WHERE round(ranking, 9) >= 0.7 QUALIFY rank <= 20"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = with_structure(spark, sf_dir, with_ctx(sample_entries(spark, sf_dir)))
    return search.hybrid(entries, search_texts(spark, sf_dir), search_vectors(spark, sf_dir), ASKED, search.Parameters(), keyword_index(spark, sf_dir))


@query(HYBRID)
def hybrid_search(spark, sf_dir):
    return searched(spark, sf_dir).select("query_id", "id", F.round("ranking", 6).alias("ranking"), "rank")


@query(f"WITH {E}, found AS ({HYBRID}), h AS (SELECT DISTINCT hash FROM found JOIN entries USING (id)) SELECT id, access_count + CASE WHEN h.hash IS NULL THEN 0 ELSE 1 END AS access_count, round(CASE WHEN h.hash IS NULL THEN rating ELSE {RATING.format(now=NOW, n='(access_count + 1)')} END, 6) AS rating FROM entries LEFT JOIN h USING (hash)")
def search_access(spark, sf_dir):
    """Entries after a search: those it has found count as accessed."""
    entries = sample_entries(spark, sf_dir)
    return search.fed_back(entries, searched(spark, sf_dir), NOW).select("id", "access_count", F.round("rating", 6).alias("rating"))


@query()
def search_snippets(spark, sf_dir):
    return search.shown(searched(spark, sf_dir), sample_entries(spark, sf_dir), search_texts(spark, sf_dir)).select("query_id", "id", "rank", "snippet")


# Evaluation

JUDGED = f"WITH {LISTS}, {FUSED.format(a='1.0::DOUBLE', b='1.0::DOUBLE', k=60)}, rel AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), hit AS (SELECT r.query_id, r.rank, rel.id IS NOT NULL AS good FROM ranked r LEFT JOIN rel USING (query_id, id)), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL)"


def relevant(spark, sf_dir) -> DataFrame:
    """(query_id, id): the documents with a benchmark item's whole text."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return evaluate.holding(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), items)


def judged(spark, sf_dir, k: int) -> DataFrame:
    """Metrics of the fused search; documents with an item's whole text are relevant."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    hits = fusion.rrf(two_lists(spark, sf_dir).withColumn("weight", F.lit(1.0)), 60, "query_id").select("query_id", "id", "rank")
    return evaluate.metrics(items, hits, stash(relevant(spark, sf_dir)), k)  # read twice


@query(f"{JUDGED}, dcg AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM hit WHERE good AND rank <= 10 GROUP BY ALL) SELECT item_id AS query_id, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n), 0), 6) AS ndcg FROM benchmark b LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN dcg ON dcg.query_id = item_id")
def ndcg_at_k(spark, sf_dir):
    return judged(spark, sf_dir, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"{JUDGED}, f AS (SELECT query_id, min(rank) AS r FROM hit WHERE good GROUP BY ALL) SELECT item_id AS query_id, round(coalesce(1.0::DOUBLE / r, 0), 6) AS reciprocal_rank FROM benchmark LEFT JOIN f ON f.query_id = item_id")
def mrr(spark, sf_dir):
    return judged(spark, sf_dir, 10).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"{JUDGED}, f AS (SELECT query_id, count(*) AS g FROM hit WHERE good AND rank <= 10 GROUP BY ALL) SELECT item_id AS query_id, round(coalesce(g::DOUBLE / n, 0), 6) AS recall FROM benchmark LEFT JOIN f ON f.query_id = item_id LEFT JOIN nr ON nr.query_id = item_id")
def recall_at_k(spark, sf_dir):
    return judged(spark, sf_dir, 10).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"{JUDGED}, dcg AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS g FROM hit WHERE good AND rank <= 10 GROUP BY ALL), f AS (SELECT query_id, min(rank) AS r FROM hit WHERE good GROUP BY ALL) SELECT count(*) AS n_queries, round(avg(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n), 0)), 6) AS ndcg, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS reciprocal_rank, round(avg(coalesce(g::DOUBLE / n, 0)), 6) AS recall FROM benchmark b LEFT JOIN nr ON nr.query_id = item_id LEFT JOIN dcg ON dcg.query_id = item_id LEFT JOIN f ON f.query_id = item_id")
def macro_metrics(spark, sf_dir):
    return evaluate.macro_average(judged(spark, sf_dir, 10)).select("n_queries", *(F.round(c, 6).alias(c) for c in ("ndcg", "reciprocal_rank", "recall")))


WIDE = evaluate.grid()


@query(f"""WITH {LISTS}, g AS (SELECT * FROM (VALUES {', '.join('({point}, {k}, {w0}::DOUBLE, {w1}::DOUBLE, {affinity}::DOUBLE, {window})'.format(**p) for p in WIDE)}) v(point, k, a, b, lift, win)),
fused AS (SELECT point, lift, query_id, id, any_value(path) AS path, sum(CASE list_no WHEN 0 THEN a ELSE b END / (k + rank)) AS s FROM lists JOIN entries USING (id), g WHERE rank <= win GROUP BY ALL),
cand AS (SELECT f.point, f.lift, f.query_id, f.id, f.path, s / max(s) OVER (PARTITION BY f.query_id, f.point) AS score, e.source_file, e.chunk_index FROM fused f JOIN entries e USING (id)),
vis AS (SELECT *, score >= max(score) OVER (PARTITION BY query_id, point) - 0.1::DOUBLE AS visible FROM cand),
sib AS (SELECT a.point, a.query_id, a.id, count(b.id) AS siblings FROM cand a LEFT JOIN vis b ON a.point = b.point AND a.query_id = b.query_id AND a.source_file = b.source_file AND abs(a.chunk_index - b.chunk_index) = 1 AND b.visible GROUP BY ALL),
boosted AS (SELECT c.*, c.score + lift * s.siblings AS boosted FROM cand c JOIN sib s USING (point, query_id, id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, point ORDER BY round(boosted, 9) DESC, round(doc_score, 9) DESC, path, chunk_index, id) AS place FROM (SELECT *, max(boosted) OVER (PARTITION BY query_id, point, source_file) AS doc_score FROM boosted)),
best AS (SELECT *, first_value(chunk_index) OVER w AS bi, first_value(boosted) OVER w AS bs, row_number() OVER w AS n FROM placed WINDOW w AS (PARTITION BY query_id, point, source_file ORDER BY place)),
kept AS (SELECT * FROM best WHERE NOT (n > 1 AND abs(bi - chunk_index) = 1 AND round(bs - boosted, 9) >= 0.1)), final AS (SELECT *, boosted / max(boosted) OVER (PARTITION BY query_id, point) AS ranking FROM kept),
top AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY query_id, point ORDER BY place) <= 10)
SELECT point, count(*) AS n, round(sum(ranking), 4) AS total, sum(id)::BIGINT AS ids FROM top GROUP BY point""")
def affinity_sweep(spark, sf_dir):
    places = sample_entries(spark, sf_dir).select("id", "source_file", "chunk_index")
    rows = evaluate.affinity_sweep(two_lists(spark, sf_dir), places, WIDE, 0.1, "query_id")
    top = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "point").orderBy("place"))).filter("n <= 10")
    return top.groupBy("point").agg(F.count("*").alias("n"), F.round(F.sum("ranking"), 4).alias("total"), F.sum("id").alias("ids"))


RRF_GRID = evaluate.rrf_points()


@query(f"""WITH {LISTS}, rel AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), g AS (SELECT * FROM (VALUES {', '.join('({point}, {k}, {w0}::DOUBLE, {w1}::DOUBLE, {min_score}::DOUBLE, {window})'.format(**p) for p in RRF_GRID)}) v(point, k, a, b, least, win)),
fused AS (SELECT point, least, query_id, id, any_value(path) AS path, sum(CASE list_no WHEN 0 THEN a ELSE b END / (k + rank)) AS s FROM lists JOIN entries USING (id), g WHERE rank <= win GROUP BY ALL),
scored AS (SELECT *, s / max(s) OVER (PARTITION BY query_id, point) AS score FROM fused),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, point ORDER BY round(score, 9) DESC, path, id) AS rank FROM scored WHERE round(score, 9) >= least QUALIFY rank <= 10)
SELECT point, count(*) AS n, round(sum(score), 4) AS total, sum(id)::BIGINT AS ids, count(rel.id) AS n_relevant, round(sum(CASE WHEN rel.id IS NULL THEN 0 ELSE 1 / log2(rank + 1) END), 4) AS dcg FROM top LEFT JOIN rel USING (query_id, id) GROUP BY point""")
def rrf_grid(spark, sf_dir):
    """At each of the 96 points the ten best of every query, how many of them are relevant, and their discounted gain."""
    top = evaluate.rrf_grid(two_lists(spark, sf_dir), RRF_GRID, "query_id").filter("rank <= 10").join(relevant(spark, sf_dir).withColumn("good", F.lit(1)), ["query_id", "id"], "left")
    gain = F.when(F.col("good") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return top.groupBy("point").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.sum("id").alias("ids"), F.count("good").alias("n_relevant"), F.round(F.sum(gain), 4).alias("dcg"))


@query(f"WITH {LISTS}, b AS (SELECT a.query_id, a.id, a.rank AS x, c.rank AS y FROM lists a JOIN lists c USING (query_id, id) WHERE a.list_no = 0 AND c.list_no = 1) SELECT p.query_id, round(sum(sign((p.x - q.x) * (p.y - q.y)))::DOUBLE / count(*), 6) AS tau FROM b p JOIN b q ON p.query_id = q.query_id AND p.id < q.id GROUP BY ALL")
def kendall_tau(spark, sf_dir):
    lists = two_lists(spark, sf_dir)
    return evaluate.kendall_tau(lists.filter("list_no = 0"), lists.filter("list_no = 1"), "query_id").select("query_id", F.round("tau", 6).alias("tau"))


@query("WITH l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY ALL), r AS (SELECT d.lang, d.n_chars::DOUBLE AS x, l.quality::DOUBLE AS y FROM documents d JOIN l USING (doc_id)), k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0::DOUBLE AS b FROM r) SELECT lang, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho, count(*) AS n FROM k GROUP BY ALL")
def spearman_rho(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(marks, "doc_id")
    return evaluate.spearman(rows, "n_chars", "quality", "lang").select("lang", F.round("rho", 6).alias("rho"), "n")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p95 FROM r WHERE place = greatest(1, ceil(0.95::DOUBLE * n))")
def latency_percentile(spark, sf_dir):
    return evaluate.nearest_rank_percentile(table(spark, sf_dir, "events"), "value", 0.95, "event_type").withColumnRenamed("value", "p95")
