"""Precision, recall and F1 against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs, once each."""
    return df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row from two tables with the same columns: true and false positives, false negatives, precision, recall, f1_score."""
    keys = predicted.columns
    both = predicted.distinct().withColumn("_p", F.lit(1)).join(truth.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "full")
    count = lambda p, t: F.coalesce(F.sum((p & t).cast("long")), F.lit(0))
    p, t = F.col("_p").isNotNull(), F.col("_t").isNotNull()
    sums = both.agg(count(p, t).alias("true_positives"), count(p, ~t).alias("false_positives"), count(~p, t).alias("false_negatives"))
    tp, fp, fn = (F.col(c) for c in sums.columns)
    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    rates = sums.withColumn("_pr", share(tp, tp + fp)).withColumn("_re", share(tp, tp + fn))
    f1 = F.when(F.col("_pr") + F.col("_re") > 0, 2 * F.col("_pr") * F.col("_re") / F.when(F.col("_pr") + F.col("_re") > 0, F.col("_pr") + F.col("_re"))).otherwise(0.0)
    return rates.select(*sums.columns, F.round("_pr", 4).alias("precision"), F.round("_re", 4).alias("recall"), F.round(f1, 4).alias("f1_score"))


def false_positive_rate(evaluation: DataFrame, total: int, truth_size: int) -> DataFrame:
    """False positives among what isn't in the truth; 0 if all is."""
    rest = total - truth_size
    return evaluation.select((F.round(F.col("false_positives") / rest, 4) if rest > 0 else F.lit(0.0)).alias("false_positive_rate"))
