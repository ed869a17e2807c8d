"""Scores of classifiers trained on the full and on the pruned data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame) -> DataFrame:
    """``(run, epoch, phase, n, accuracy)`` from rows ``(run, epoch, phase, pred, label)``."""
    hit = (F.col("pred") == F.col("label")).cast("double")
    return predictions.groupBy("run", "epoch", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")
    )
