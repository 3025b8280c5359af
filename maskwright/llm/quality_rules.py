"""Operator 7, quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from . import text_stats

#: Rules, higher is worse: symbols a word character, upper-case letters, marks of tables and shouting a word, repeated lines and words.
RULES = ("symbols", "upper", "pipes", "shouts", "dup_lines", "repeats")
#: Cutoffs tried are k / BINS for k below BINS.
BINS = 128


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed in logarithms."""
    if k >= n or p <= 0:
        return 1.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x + 1) for x in i]) + np.array([math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(math.lgamma(n + 1) - lg + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def lowest_safe_cutoff(counts: np.ndarray, risk: float, level: float) -> float | None:
    """The lowest cutoff whose false rejections are provably at most ``risk``.

    ``counts[b]`` good documents of the holdout have a value in bin b. Cutoffs
    are tested from the mildest on, each by the exact binomial bound at
    ``level``, and the first failure ends the sequence, so the sequence needs
    no correction of its own. None: not even the mildest passes.
    """
    n, above, best = int(counts.sum()), 0, None
    for b in range(BINS - 1, 0, -1):
        above += int(counts[b])  # values at or above b / BINS are rejected
        if not n or binomial_tail(above, n, risk) > level:
            break
        best = b / BINS
    return best


def _value(rule: str) -> Column:
    return F.least(F.get("features", F.lit(text_stats.FEATURES.index(rule))).cast("double"), F.lit(1.0))


def thresholds(stats: DataFrame, labels: DataFrame, stratum: str = "stratum", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """One row per stratum and rule with a safe cutoff.

    The holdout are the documents labelled good. A stratum's share of wrongly
    rejected good documents stays below ``risk`` over all rules together, with
    probability 1 - ``level`` over all strata and rules (Bonferroni over both;
    the risk is split evenly over rules).
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    held = stats.join(good, "doc_id", "left_semi")
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.floor(_value(r) * (BINS - 1)).cast("int").alias("bin")) for r in RULES]))
    histogram = held.select(stratum, values.alias("v")).groupBy(stratum, "v.rule", "v.bin").agg(F.count("*").alias("n"))
    histogram = S.save(histogram, "histogram")
    tests = max(1, histogram.select(stratum).distinct().count()) * len(RULES)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BINS, dtype=np.int64)
        np.add.at(counts, rows["bin"].to_numpy(), rows["n"].to_numpy())
        cut = lowest_safe_cutoff(counts, risk / len(RULES), level / tests)
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [cut]}).dropna()

    return histogram.groupBy(stratum, "rule").applyInPandas(choose, "stratum string, rule string, cutoff double")


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Base counts, base verdict and the verdict under risk-controlled cutoffs.

    Null texts have no words (and fail the base rules); a null stratum and an
    empty one are one stratum; a stratum without enough labelled good documents has no
    cutoff and rejects by the base rules only. Repeated rows are judged alike,
    each on its own row. Labels of a document that disagree count as good if
    one says so. Empty tables give no rows. The text is read once.
    """
    keep = docs.select("doc_id", F.col("text").alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    stats = S.save(_with_stratum(keep), "text-stats")
    cuts = thresholds(stats, labels, "stratum", risk, level).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = S.save(cuts, "cutoffs")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(F.floor(_value(rule) * (BINS - 1)) / F.lit(float(BINS)) >= F.col("cuts")[rule], F.lit(False))
    return stats.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~over).alias("kept")
    )


def _with_stratum(docs: DataFrame) -> DataFrame:
    """Statistics that carry the stratum along."""
    import pyarrow as pa

    def run(batch: pa.RecordBatch) -> dict:
        rows = zip(*map(text_stats.describe, batch.column(1).to_pylist()), strict=True)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features")
        return {"doc_id": batch.column(0)} | dict(zip(names, rows, strict=True)) | {"stratum": batch.column(2)}

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "stratum")
    return S.map_batches(whole, run, text_stats.COLUMNS + ", stratum string")
