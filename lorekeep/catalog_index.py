"""Queries of the keyword index: phrases, sections of several words, maintenance by deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.catalog import RAW, E, Q, _tokens, bm25_sql, keyword_index, query, raw_searches, table, with_ctx
from lorekeep.functions import text as tx
from lorekeep.operators import index, keyword
from lorekeep.plans import planner
from lorekeep.sources.bank import sample_entries
from lorekeep.sources.tables import kept_path, shared_folder

# Phrases of two to six tokens, from every benchmark item

PHRASES = f"SELECT item_id AS query_id, array_to_string(t[4:5 + item_id % 5], ' ') AS term FROM (SELECT item_id, {_tokens('text')} AS t FROM benchmark) WHERE len(t) > 3"


@query(f"WITH {E}, {bm25_sql(PHRASES, True)} SELECT query_id, id, round(score, 6) AS score FROM hits")
def phrase_search(spark, sf_dir):
    """All entries with a phrase of each benchmark item: its 4th to at most 9th token."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.tokens("text").alias("t")).filter("size(t) > 3")
    phrases = items.select("query_id", F.array(F.array_join(F.slice("t", F.lit(4), (F.col("query_id") % 5 + 2).cast("int")), " ")).alias("terms"))
    return keyword.any_of(phrases, keyword_index(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


# Paths with sections of one to five words

SECTIONED = E.replace("entries AS (SELECT d.doc_id AS id", "entries AS (SELECT * REPLACE (array_to_string(" + _tokens("value") + "[1:1 + id % 5], ' ') AS section) FROM (SELECT d.doc_id AS id", 1) + ")"
WANTED = f"""wanted AS (SELECT item_id AS query_id, id AS target, {_tokens('source_file')} AS file, section FROM benchmark JOIN entries ON id = item_id WHERE section <> ''),
path_terms AS (SELECT query_id, unnest(file || [section]) AS term FROM wanted)"""


def sectioned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose section is the first one to five tokens of their text."""
    entries = sample_entries(spark, sf_dir)
    return entries.withColumn("section", F.array_join(F.slice(tx.tokens("value"), F.lit(1), (F.col("id") % 5 + 1).cast("int")), " "))


@query(f"WITH {SECTIONED}, {WANTED}, {bm25_sql('SELECT query_id, term FROM path_terms', True, {'source_file': 8.0, 'section': 16.0})} SELECT query_id, id, round(score, 6) AS score FROM hits JOIN wanted USING (query_id) WHERE n_terms = len(list_distinct(file || [section]))")
def section_search(spark, sf_dir):
    """For every benchmark item the entry of its number is looked for by its path and section, as a text such as docs/3.md#first-words."""
    entries = sectioned_entries(spark, sf_dir)
    path = kept_path(spark, f"sectioned index {index.FORMAT}", table(spark, sf_dir, "documents"))
    kept = index.read(spark, path) or index.build(with_ctx(entries), path)
    targets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(entries.select(F.col("id").alias("query_id"), "source_file", "section"), "query_id").filter("section <> ''")
    texts = targets.select("query_id", F.concat("source_file", F.lit("#"), F.translate("section", " ", "-")).alias("text"))
    return keyword.planned(planner.planned(texts), kept, 20).select("query_id", "id", F.round("score", 6).alias("score"))


# Maintenance

CHANGED = E.replace("entries AS (", "every_entry AS (", 1) + ", entries AS (SELECT * FROM every_entry WHERE id % 10 <> 3)"


@query(f"WITH {CHANGED}, {Q}, {bm25_sql(RAW)} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM hits QUALIFY rank <= 10")
def index_maintenance(spark, sf_dir):
    """An index of the bank as it was, brought up to date after a tenth of the entries came, a tenth changed and a tenth went, answers like one made anew."""
    now = with_ctx(sample_entries(spark, sf_dir)).filter("id % 10 <> 3")
    kind = F.col("id") % 10
    before = with_ctx(sample_entries(spark, sf_dir)).filter(kind != 1).withColumn("value", F.when(kind == 2, F.concat_ws(" ", F.lit("older words of"), "section", F.substring("value", 1, 400))).otherwise(F.col("value")))
    path = shared_folder(spark)
    index.build(before, path)
    kept = index.maintain(now, path)
    return keyword.ranked(keyword.any_of(raw_searches(spark, sf_dir), kept, k=10), 10, "query_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")
