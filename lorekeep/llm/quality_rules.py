"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose statistic is above a cutoff. Cutoffs come from labelled holdouts, for each stratum
(declared values of a column, all others together) apart, and the rules of a stratum are tested together: a vector of cutoffs, one
for each rule, is safe if an exact binomial test refutes that more than RISK of good documents are rejected by any of its rules.
The level is CONFIDENCE's remainder over the strata (Bonferroni); within one, vectors are tested along a path on which all
cutoffs fall, until one fails (a fixed sequence needs no further correction). So with that confidence no stratum loses more
than RISK of its good documents, all rules together. A vector above a safe one rejects less and is safe too; so of
each rule's cutoffs down to that of the last safe vector the one is taken with the largest share of rejected bad documents less PRICE
times that of good ones, the highest among equals; a rule for which that is not above 0 in a stratum is not used there.

The path must not depend on the documents it is tested with. It is laid by guides: where a stratum has OWN times the least number
of good labels with which a test can succeed, by a fifth of them, hash-drawn, and the others test; else by the good labels of the other
strata, and all its own test. A rule's base is the cutoff that is best by guides and bad labels; all rules reach their bases
in the same step and go on below, those that seem of no use last. Without guides all cutoffs are equal in every step.

Only counts for strata x rules x cutoffs and strata x steps reach the driver, whatever the input's size.

Defined results: a null text is empty; a text without words fails the base rules; several labels of a doc_id count
as bad if one is; labels that are neither 0 nor 1 and rows without doc_id are not used for calibration; in a stratum with fewer
labelled good documents than a test can succeed with (228), or without bad ones, no rule is used, calibrated is false and kept is the
base rules' verdict; a warning names such strata; repeated rows are judged one by one; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm._shared import documents, stash
from lorekeep.llm._stats import NAMES, text_stats

RISK, CONFIDENCE, PRICE = 0.02, 0.95, 10
OWN = 4
STRATA = ("en", "de", "fr", "es")
GRID = tuple(k / 32 for k in range(1, 17)) + (0.625, 0.75, 0.875)

#: The statistics of the rules, each from 0 to about 1.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "shouting": "n_upper / greatest(word_chars, 1)",
    "punctuation": "n_punct / greatest(word_chars, 1)",
    "top_word": "n_top_word / (n_words + 20)",  # so that a few words don't make an extreme share
}


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), k below the mean: terms from the largest down until they no longer count."""
    if k >= n:
        return 1.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    top, total, now = term, 0.0, 0.0
    for i in range(k, -1, -1):
        total += (now := math.exp(term - top))
        if now < 1e-17 * total and i < n * p:
            break
        if i:
            term += math.log(i) - math.log(n - i + 1) + math.log1p(-p) - math.log(p)
    return min(1.0, math.exp(top + math.log(total)))


def is_safe(rejected: int, n: int, risk: float, level: float) -> bool:
    """Whether the exact test at this level refutes a false rejection rate above risk: equal to the Clopper-Pearson bound being at most risk."""
    return n > 0 and rejected < n * risk and binomial_at_most(rejected, n, risk) <= level


def least_labels(risk: float, level: float) -> int:
    """The least number of good documents with which a vector that rejects none of them is safe."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def bases(guides: list[list[int]], n_guides: int, bad: list[list[int]], n_bad: int) -> list[int]:
    """For each rule the number of the grid cutoff that is best by its counts of rejected guides and bad documents; beyond the grid if none is of use."""
    if not n_guides:
        return [0] * len(bad)
    gains = [[b / n_bad - PRICE * g / n_guides for g, b in zip(good, poor)] for good, poor in zip(guides, bad)]
    return [max(range(len(gain)), key=lambda k: (gain[k], k)) if max(gain) > 0 else len(gain) for gain in gains]


def last_safe_step(first_rejected: dict[int, int], n: int, steps: int, risk: float, level: float) -> int | None:
    """The last step before the first that is not safe; first_rejected counts the tested documents by the step that rejects them first."""
    rejected, found = 0, None
    for step in range(steps):
        rejected += first_rejected.get(step, 0)
        if not is_safe(rejected, n, risk, level):
            break
        found = step
    return found


def calibrate(stats: DataFrame, labels: DataFrame, stratum: Column, strata: tuple[str, ...] = STRATA, risk: float = RISK, confidence: float = CONFIDENCE, grid: tuple[float, ...] = GRID) -> tuple[dict[tuple[str, str], float], set[str]]:
    """The cutoff of each (stratum, rule) that is used, and the strata with enough labels."""
    grid, size = sorted(grid), len(grid)
    marks = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    above = [sum((F.expr(x) > cut).cast("int") for cut in grid).alias(r) for r, x in RULES.items()]
    fifth = (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0).alias("fifth")
    seen = stash(stats.join(marks, "doc_id").select(stratum.alias("stratum"), "quality", fifth, *above))
    counts = [F.count_if(F.col(r) > k).alias(f"{r}_{k}") for r in RULES for k in range(size)]
    rows = seen.groupBy("stratum", "quality", "fifth").agg(F.count("*").alias("n"), *counts).collect()

    def summed(wanted) -> tuple[int, list[list[int]]]:
        some = [row for row in rows if wanted(row)]
        return sum(row["n"] for row in some), [[sum(row[f"{r}_{k}"] for row in some) for k in range(size)] for r in RULES]

    level = (1 - confidence) / (len(strata) + 1)
    least, starts, own, good, bad = least_labels(risk, level), {}, {}, {}, {}
    for name in {row["stratum"] for row in rows}:
        good[name] = summed(lambda row: row["stratum"] == name and row["quality"] == 1)
        bad[name] = summed(lambda row: row["stratum"] == name and row["quality"] == 0)
        if good[name][0] < least or not bad[name][0]:
            continue
        own[name] = good[name][0] >= OWN * least
        n_guides, guides = summed(lambda row: row["quality"] == 1 and (row["stratum"] == name and row["fifth"] if own[name] else row["stratum"] != name))
        starts[name] = [base + size for base in bases(guides, n_guides, bad[name][1], bad[name][0])]
    if missing := sorted({*strata, "other"} - set(starts)):
        logging.getLogger(__name__).warning("No quality rule is used for want of labels (%d good and some bad ones): %s", least, ", ".join(missing))
    if not starts:
        return {}, set()
    # In a step a rule's cutoff has the number start - step: it rejects what is above that many cutoffs and one more
    first = F.coalesce(*(F.when(F.col("stratum") == name, F.least(*(F.when(F.col(r) > 0, start + 1 - F.col(r)) for r, start in zip(RULES, begin)))) for name, begin in starts.items()))
    tested = F.lit(False)
    for name in starts:
        tested |= (F.col("stratum") == name) & ~F.col("fifth") if own[name] else F.col("stratum") == name
    steps = seen.filter((F.col("quality") == 1) & tested).groupBy("stratum", first.alias("step")).count().collect()
    cutoffs = {}
    for name, begin in starts.items():
        at = {row["step"]: row["count"] for row in steps if row["stratum"] == name}
        step = last_safe_step(at, sum(at.values()), 2 * size + 1, risk, level)
        if step is None:
            continue
        for rule, start, g, b in zip(RULES, begin, good[name][1], bad[name][1]):
            gains = [(b[k] / bad[name][0] - PRICE * g[k] / good[name][0], grid[k]) for k in range(max(0, start - step), size)]
            if gains and max(gains)[0] > 0:
                cutoffs[name, rule] = max(gains)[1]
    return cutoffs, set(starts)


def stratum_of(column: str = "lang", strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(F.col(column).isin(*strata), F.col(column)).otherwise("other")


def judge(stats: DataFrame, cutoffs: dict[tuple[str, str], float], calibrated: set[str], stratum: Column) -> DataFrame:
    """stats with base_failed, the rules that reject it, whether its stratum had enough labels, and kept."""
    broken = [F.when((stratum == name) & (F.expr(RULES[rule]) > cut), F.lit(rule)) for (name, rule), cut in sorted(cutoffs.items())]
    out = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("rejected_by", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    out = out.withColumn("calibrated", stratum.isin(*sorted(calibrated)) if calibrated else F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def rule_verdicts(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """For each row of docs: doc_id, the statistics, base_failed, rejected_by, calibrated and kept."""
    stats = stash(text_stats(docs, "doc_id", "lang"))
    return judge(stats, *calibrate(stats, labels, stratum_of(), **parameters), stratum_of())


def keep(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that the rules keep."""
    stats = stash(text_stats(docs, "doc_id", "lang"))
    found = calibrate(stats, labels, stratum_of(), **parameters)
    rows = text_stats(docs.select("lang", "text", F.struct("*").alias("document")), "lang", "document")
    return judge(rows, *found, stratum_of()).filter("kept").select("document.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_verdicts(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", *NAMES[:5], "base_failed", "kept", "rejected_by", "calibrated")
