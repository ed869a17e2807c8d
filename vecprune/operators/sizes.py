"""Cluster sizes and what is reported from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.operators.joins import join_on_keys
from vecprune.operators.ordinal import ordinal

# Fixed value: sizes above this share the last bin of the histogram.
LAST_EXACT_BIN = 10


def cluster_sizes(df: DataFrame) -> DataFrame:
    """``(cluster_id, cluster_size)``."""
    return df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))


def size_summary(sizes: DataFrame, include_empty: bool = False) -> DataFrame:
    """One row: clusters, max, min and mean size, singletons.

    ``include_empty`` also counts the ids below the largest one that no item has.
    """
    summary = sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.max("cluster_size").alias("max_size"),
        F.min("cluster_size").alias("min_size"),
        F.sum("cluster_size").alias("_items"),
        F.count_if(F.col("cluster_size") == 1).alias("n_singletons"),
        (F.max("cluster_id") + 1).cast("bigint").alias("_ids"),
    )
    if include_empty:
        # Ids are distinct, so a gap exists exactly if there are fewer clusters than ids.
        gap = F.col("n_clusters") < F.col("_ids")
        summary = summary.withColumn(
            "min_size", F.when(gap, F.lit(0)).otherwise(F.col("min_size")).cast("bigint")
        ).withColumn("n_clusters", F.col("_ids"))
    mean = F.col("_items") / F.nullif("n_clusters", F.lit(0))
    return summary.select(
        "n_clusters", "max_size", "min_size", mean.alias("mean_size"), "n_singletons"
    )


def size_histogram(sizes: DataFrame) -> DataFrame:
    """Clusters per size 1..10 and above; ``size_bin`` 11 is "more than 10".  Empty bins
    are listed with 0."""
    last = LAST_EXACT_BIN + 1
    counts = sizes.groupBy(F.least("cluster_size", F.lit(last)).cast("int").alias("size_bin")).agg(
        F.count(F.lit(1)).alias("n_clusters")
    )
    bins = sizes.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("size_bin"))
    return bins.join(counts, "size_bin", "left").na.fill(0, ["n_clusters"])


def cluster_members(df: DataFrame) -> DataFrame:
    """Members of each cluster in id order, as rows ``(cluster_id, member_no, item_id, ...)``.

    Rows, not a list per cluster: a list would have to fit in one task.
    """
    return ordinal(df, [F.col("item_id").asc()], ["cluster_id"], "member_no")


def rank_clusters(df: DataFrame) -> DataFrame:
    """``(cluster_id, cluster_size, size_rank)``: largest first, ties by the lowest item id.
    ``size_rank`` starts at 0."""
    sizes = df.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min("item_id").alias("_first")
    )
    order = [F.col("cluster_size").desc(), F.col("_first").asc()]
    ranked = ordinal(sizes, order, name="_rank")
    return ranked.select("cluster_id", "cluster_size", (F.col("_rank") - 1).alias("size_rank"))


def ranked_members(df: DataFrame) -> DataFrame:
    """Every member with the size rank of its cluster."""
    return join_on_keys(df, rank_clusters(df).select("cluster_id", "size_rank"), ["cluster_id"])


def top_clusters(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest clusters, ties by the lowest item id."""
    sizes = df.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min("item_id").alias("_first")
    )
    return sizes.orderBy(F.col("cluster_size").desc(), "_first").limit(n).drop("_first")


def one_cluster(df: DataFrame, cluster_id: int) -> DataFrame:
    return df.where(F.col("cluster_id") == cluster_id)


def cluster_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """Clusters ``low`` up to, but not including, ``high``."""
    return df.where((F.col("cluster_id") >= low) & (F.col("cluster_id") < high))
