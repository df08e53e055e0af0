"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal. The score is the
logistic of the difference of the two Gaussian log densities (Mahalanobis distances by forward substitution with cached
Cholesky factors) plus the log ratio of the class sizes, tempered so that far points do not all score 0 or 1.

All labelled training rows count: tasks sum the outer products of (1, x) per class, so one small matrix per class
reaches the driver. Every row is scored in its task from the statistics of its whole text.

Defined results: a null text is empty and is scored; several labels of a doc_id count as bad if one is; rows without
doc_id are neither learned from nor held out of anything: held_out is null; where a class has no training row every score is 0.5;
repeated rows are scored one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import documents, lean, stash
from lorekeep.llm._stats import NAMES, text_stats

SHRINK, DIAGONAL, TEMPER, CUT = 0.1, 0.1, 0.5, 0.3


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics: logarithms of sizes, square roots of shares."""
    x = {k: v.astype(np.float64) for k, v in x.items()}
    words, chars, lines = x["n_words"] + 4, x["word_chars"] + 20, x["n_lines"] + 1  # so that a few words don't make an extreme share
    mean = (x["word_chars"] + 20) / words
    return np.column_stack([
        np.log1p(x["n_words"]), np.log1p(mean), np.log1p(np.sqrt(np.maximum((x["sum_sq_word"] + 100) / words - mean**2, 0))),
        np.sqrt(x["n_symbols"] / chars), np.sqrt(x["n_punct"] / chars), np.sqrt(x["n_upper"] / chars), np.sqrt(x["n_digits"] / chars),
        np.sqrt(x["n_repeat_words"] / words), np.sqrt(x["n_dup_lines"] / lines), np.log1p(x["n_unique_words"]) - np.log1p(x["n_words"]), np.sqrt(x["n_top_word"] / words),
        np.sqrt(x["n_long_words"] / words), np.sqrt(x["n_short_words"] / words), np.log1p(x["n_words"] / lines),
    ])


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return features({n: batch.column(n).to_numpy() for n in NAMES})


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For each class the sum of the outer products of (1, x) over its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, marks = np.column_stack([np.ones(batch.num_rows), _columns(batch)]), batch.column("quality").to_numpy()
            for mark in np.unique(marks).tolist():
                total[mark] = total.get(mark, 0) + x[marks == mark].T @ x[marks == mark]
        for mark, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([mark] * m.size), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["quality", "cell", "value"])

    cells = labelled.mapInArrow(lean(run), "quality long, cell long, value double").groupBy("quality", "cell").agg(F.sum("value").alias("value")).collect()
    found: dict[int, np.ndarray] = {}
    for quality, cell, value in cells:
        d = round(sum(1 for q, _, _ in cells if q == quality) ** 0.5) if quality not in found else len(found[quality])
        found.setdefault(quality, np.zeros((d, d))).ravel()[cell] = value
    return found


def fit(sums: dict[int, np.ndarray], shrink: float = SHRINK, diagonal: float = DIAGONAL) -> dict | None:
    """Means, Cholesky factors, log determinants and log sizes of classes 0 and 1."""
    if not {0, 1} <= set(sums):
        return None
    mean = {k: m[0, 1:] / m[0, 0] for k, m in sums.items()}
    cov = {k: m[1:, 1:] / m[0, 0] - np.outer(mean[k], mean[k]) for k, m in sums.items()}
    size = {k: m[0, 0] for k, m in sums.items()}
    pooled = (size[0] * cov[0] + size[1] * cov[1]) / (size[0] + size[1])
    pooled = pooled + np.diag(np.diag(pooled) * 0.01 + 1e-4)
    found = {}
    for k in (0, 1):
        own = (1 - shrink) * cov[k] + shrink * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + 1e-4 * np.eye(len(own))
        factor = np.linalg.cholesky(own)
        found[k] = (mean[k], factor, 2 * np.log(np.diag(factor)).sum(), np.log(size[k]))
    return found


def solved(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows z with factor z = y for the rows of y, by forward substitution; factor is lower triangular."""
    z = np.empty_like(y)
    for k in range(len(factor)):
        z[:, k] = (y[:, k] - z[:, :k] @ factor[k, :k]) / factor[k, k]
    return z


def score(x: np.ndarray, model: dict | None, temper: float = TEMPER) -> np.ndarray:
    """From 0 to 1, higher: class 1 likelier."""
    if model is None:
        return np.full(len(x), 0.5)
    density = {k: -0.5 * ((solved(factor, x - mean) ** 2).sum(1) + logdet) for k, (mean, factor, logdet, _) in model.items()}
    return 1 / (1 + np.exp(-np.clip(temper * (density[1] - density[0]) + model[1][3] - model[0][3], -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of each row. Labels of rows whose crc32(doc_id as text) mod 5 is 0 are not learned."""
    stats = stash(text_stats(docs, "doc_id").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0))
    marks = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    model = fit(moments(stats.filter("NOT held_out").join(marks, "doc_id").select("quality", *NAMES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(_columns(batch), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op9_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
