"""Checks on the input: bad vectors go to a rejects table, duplicate keys are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject_reason(vec_col: str, dim: int) -> Column:
    """Why a vector cannot be used, NULL if it can."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vec.isNull(), "null")
        .when(F.size(vec) != dim, "dimension")
        .when(bad, "not finite")
    )


def vector_dim(df: DataFrame, vec_col: str = "embedding") -> int:
    """The most frequent dimension, the larger one of equally frequent ones; 0 without vectors."""
    counts = df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("dim")).count()
    row = counts.agg(F.max(F.struct("count", "dim")).alias("most")).first()
    return 0 if row.most is None else row.most["dim"]


def split_valid(
    df: DataFrame, vec_col: str = "embedding", dim: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(usable rows, rejected rows with a reason column)``; every row is in one of them."""
    dim = vector_dim(df, vec_col) if dim is None else dim
    reason = reject_reason(vec_col, dim)
    usable = df.where(reason.isNull())
    rejects = df.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return usable, rejects


def repeated_keys(
    df: DataFrame, key_col: str = "path", cluster_col: str = "cluster_id"
) -> DataFrame:
    """Keys stored more than once in a cluster."""
    counts = df.groupBy(cluster_col, key_col).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") > 1)


def assert_unique(
    df: DataFrame, key_col: str = "path", cluster_col: str = "cluster_id"
) -> DataFrame:
    """``df`` itself, after checking that no cluster stores a key twice."""
    example = repeated_keys(df, key_col, cluster_col).first()
    if example is not None:
        raise ValueError(f"key {example[key_col]!r} is stored {example['copies']} times in a cluster")
    return df
