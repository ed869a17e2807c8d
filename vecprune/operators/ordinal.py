"""Exact row numbers, also for groups far too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecprune.operators.joins import join_on_keys
from vecprune.staging import stage_table

# A window sorts one group in one task (spilling); beyond this many rows in the largest
# group the order is taken from a range sort that cuts groups across tasks.
HOT_ROWS = 1_000_000
# The same for rows that carry vectors or other lists, and for numbers over a whole table.
HOT_WIDE_ROWS = 50_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Size of the largest group of ``keys``: one narrow aggregate, one number back."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def ordinal(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "pos",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``name``: the 1-based BIGINT position of each row in its ``within`` group.

    ``order`` must be total inside a group (end it with a unique id).  ``largest`` is an
    upper bound of the largest group if the caller knows one; otherwise it is counted.
    """
    within = list(within)
    if largest is None:
        largest = largest_group(df, within)
    wide = any(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields)
    if largest <= (min(hot_rows, HOT_WIDE_ROWS) if wide or not within else hot_rows):
        # No group: the constant key keeps the window explicit; its size was just checked.
        window = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))

    keys = [F.col(c) for c in within] + list(order)
    # The range sort looks at its input twice, so what leads to it is computed before.
    ordered = (
        stage_table(df, "unordered")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # Written once: the partition a row fell into must be the same in both uses below.
    staged = stage_table(ordered, "ordinal").withColumn("_run", F.shiftright("_row", 33))
    runs = staged.groupBy(*within, "_run").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # At most one row per (group, task): small however large the group is.
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_run").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.select(
        *within,
        "_run",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    position = (F.col("_row") + F.col("_shift")).cast("bigint").alias(name)
    return join_on_keys(staged, runs, [*within, "_run"]).select(*df.columns, position)
