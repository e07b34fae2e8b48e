"""Evaluation of verdicts against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to six digits, 0 if there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


def verdict_metrics(cases: DataFrame, expected_positive: list[str], predicted_positive: list[str]) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1 (of the rounded two) and false-positive rate of (expected, predicted)."""
    e, p = F.col("expected").isin(expected_positive), F.col("predicted").isin(predicted_positive)
    counts = cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("expected") == F.col("predicted")).alias("correct"),
        F.count_if(e & p).alias("true_positive"),
        F.count_if(~e & p).alias("false_positive"),
        F.count_if(~e & ~p).alias("true_negative"),
        F.count_if(e & ~p).alias("false_negative"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    rows = counts.withColumns({"accuracy": ratio(F.col("correct"), F.col("total")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_positive_rate": ratio(fp, fp + tn)})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))
