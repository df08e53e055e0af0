"""Token counts from an exact length histogram.

Documents are aggregated by their encoded length; suffix sums over the lengths then answer, for every context limit, how many
documents are longer, how many tokens there are in all and how many are left when each document is truncated. The sums go in two
steps, over blocks of lengths and within a block, so that no task sees more than a block's lengths or one row per block.

Defined results: null and empty texts have length 0; repeated rows count as often as they are; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm._shared import decoded, documents, lean, stash
from lorekeep.llm._tokens import default_path, encoder

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each encoded length: n_tokens, n_docs."""
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            sizes = [len(encode.ids(x)) // encode.dtype.itemsize for _, _, each in decoded(batch.column(0)) for x in each]
            found, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(lean(run, "encoder"), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def answers(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit, from rows (n_tokens, n_docs):

    docs_longer, tokens_longer (of documents above the limit), tokens_truncated (all documents cut to the limit), tokens_total, and
    quantile, the share of documents that fit.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later, everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select("block", *(F.coalesce(F.sum(f"block_{x}").over(later), F.lit(0)).alias(f"{x}_later") for x in ("docs", "tokens")), *(F.sum(f"block_{x}").over(everything).alias(f"all_{x}") for x in ("docs", "tokens")))
    above = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, "block").select("n_tokens", "n_docs", *((F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(f"{x}_later")).alias(f"{x}_longer") for c, x in (("n_docs", "docs"), ("tokens", "tokens"))), "all_docs", "all_tokens")
    return rows.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_truncated"),
        F.col("all_tokens").alias("tokens_total"), (1 - F.try_divide("docs_longer", "all_docs")).alias("quantile"),
    )


def answers_for(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """What answers() says, for each of these context limits (n_tokens), whether or not a document has that length.

    A limit is a length of no documents: it takes part in the same sums, and every limit has one row.
    """
    asked = limits.select(F.col("n_tokens").cast("long").alias("n_tokens")).filter("n_tokens >= 0").distinct()
    both = histogram.withColumn("asked", F.lit(False)).unionByName(asked.select("n_tokens", F.lit(0).cast("long").alias("n_docs"), F.lit(True).alias("asked")))
    both = both.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked"))
    return answers(both.select("n_tokens", "n_docs")).join(asked, "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(stash(lengths(documents(spark, sf_dir, "text"))))
