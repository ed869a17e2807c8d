"""Order of the items inside their cluster, and what is derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecprune.functions.hashing import seeded_hash
from vecprune.operators.joins import join_on_keys
from vecprune.operators.ordinal import HOT_ROWS, ordinal
from vecprune.options import check_policy

# Distances are compared at this many significant digits, so that exact copies tie and fall
# back to the item id whichever kernel computed them, at every scale.
DIST_DIGITS = 9


def significant(col: str, digits: int = DIST_DIGITS) -> Column:
    """The number rounded to so many significant digits; 0 and NULL stay."""
    value = F.col(col).cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
    return F.when(value == 0.0, F.lit(0.0)).otherwise(F.round(value / unit, digits - 1) * unit)


def _dist_order(keep_hard: bool, dist_col: str, id_col: str) -> list[Column]:
    dist = significant(dist_col)
    return [dist.desc() if keep_hard else dist.asc(), F.col(id_col).asc()]


def rank_within_cluster(
    df: DataFrame,
    keep_hard: bool = True,
    *,
    cluster_col: str = "cluster_id",
    dist_col: str = "dist",
    id_col: str = "item_id",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``pos``: 1 is the farthest from the centroid (``keep_hard``) or the nearest.
    Ties go to the lower id in both directions."""
    order = _dist_order(keep_hard, dist_col, id_col)
    return ordinal(df, order, [cluster_col], "pos", hot_rows, largest)


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "cluster_size") -> DataFrame:
    """Add the row count of each group; the join side has one row per group."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return join_on_keys(df, sizes, keys)


def order_policy(
    df: DataFrame,
    which: str = "hard",
    seed: int = 1234,
    *,
    cluster_col: str = "cluster_id",
    id_col: str = "item_id",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``order_pos``, the order in which items of a cluster are kept, next to ``pos``.

    ``hard`` is the rank itself, ``easy`` its exact reverse, ``random`` a shuffle that
    depends on the seed and the ids only.
    """
    check_policy(which)
    if which == "hard":
        return df.withColumn("order_pos", F.col("pos"))
    if which == "easy":
        sized = with_group_size(df, [cluster_col], "_n")
        return sized.withColumn("order_pos", F.col("_n") + 1 - F.col("pos")).drop("_n")
    hashed = df.withColumn("_hash", seeded_hash(seed, id_col))
    order = [F.col("_hash").asc(), F.col(id_col).asc()]
    return ordinal(hashed, order, [cluster_col], "order_pos", hot_rows, largest).drop("_hash")


def split_clusters(
    df: DataFrame, max_size: int, *, cluster_col: str = "cluster_id", order_col: str = "order_pos"
) -> DataFrame:
    """Add ``part``: clusters above ``max_size`` are cut into near-equal consecutive parts.
    Comparing only inside a part is the approximate mode for oversized clusters."""
    if max_size < 1:
        raise ValueError("max_size must be positive")
    sized = with_group_size(df, [cluster_col], "_n").withColumn(
        "_parts", F.expr(f"(_n + {max_size} - 1) div {max_size}")
    )
    part = F.expr(f"(({order_col} * _parts) - 1) div _n").cast("int")
    return sized.withColumn("part", part).drop("_n", "_parts")
