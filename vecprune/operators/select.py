"""Order statistics without a sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def order_statistic(df: DataFrame, value_col: str, rank: int, bins: int = BINS) -> float | None:
    """The ``rank``-th smallest value (from 1), NULLs left out; NULL if there are fewer.

    A histogram over the present range tells the bin that holds it, which is the next range,
    until a bin holds a single value.  Each pass is an aggregate of at most ``bins`` rows; a
    double is found after a few passes, whatever the distribution.
    """
    values = df.select(F.col(value_col).cast("double").alias("v")).where("v IS NOT NULL")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not 1 <= rank <= n:
        return None
    while low < high:
        width = (high - low) / bins
        # Ends that are next to each other, or too close for a width, are told apart as they are.
        bin_no = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if width > 0 else (F.col("v") > low).cast("long")
        some = values.where(F.col("v").between(low, high))
        rows = some.groupBy(bin_no.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(rows.collect(), key=lambda r: r.low):
            if rank <= row.n:
                break
            rank -= row.n
        low, high = row.low, row.high
    return low


def eps_for_kept(df: DataFrame, fractions: Sequence[float], sim_col: str = "max_earlier_sim") -> DataFrame:
    """``(fraction, eps)``: the largest eps that keeps at least this fraction of the items.

    An item is kept if its similarity to every earlier one is at most ``1 - eps``; so the
    similarity of the last item that has to stay gives the eps.  eps is NULL if items with a
    similarity of 1 would have to stay, which none keeps, and at most 1.
    """
    spark = df.sparkSession
    n = df.where(F.col(sim_col).isNotNull()).count()
    rows = []
    for fraction in fractions:
        if not 0.0 <= fraction <= 1.0:
            raise ValueError(f"a fraction must lie in [0, 1], got {fraction}")
        # As many as the fraction asks for, a rounding error of the product aside.
        wanted = math.ceil(fraction * n - 1e-9)
        sim = order_statistic(df, sim_col, wanted) if wanted else 0.0
        eps = None if sim is None or sim >= 1.0 else min(1.0, 1.0 - sim)
        rows.append((float(fraction), eps))
    return spark.createDataFrame(rows, "fraction double, eps double")
