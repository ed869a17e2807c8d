"""Outputs.  Clusters are rows in partitioned tables, never a file each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecprune.functions.names import EXPORTED_KEY_WIDTH, truncate_key
from vecprune.operators.joins import join_on_keys
from vecprune.operators.sizes import (
    cluster_range,
    cluster_sizes,
    rank_clusters,
    ranked_members,
    size_histogram,
    size_summary,
)
from vecprune.staging import stage_table, table_exists

BUCKETS = 64


def write_clusters(assigned: DataFrame, centroids: DataFrame, path: str, mode: str = "error") -> None:
    """Assignments and centroids below one folder."""
    assigned.write.mode(mode).parquet(f"{path}/assignments")
    centroids.write.mode(mode).parquet(f"{path}/centroids")


def _bucketed(df: DataFrame, key: str, bucket_col: str, buckets: int) -> DataFrame:
    """Rows spread for a write partitioned by ``bucket_col``: sorted ranges, so a bucket
    with a hot cluster is shared by several tasks."""
    with_bucket = df.withColumn(bucket_col, (F.col(key) % buckets).cast("int"))
    order = [bucket_col, key] + [c for c in ("pos", "item_id") if c in df.columns]
    # Written first, as the range partitioning looks at its input twice.
    return stage_table(with_bucket, "bucketed").repartitionByRange(*order).sortWithinPartitions(*order)


def write_sorted(
    ranked: DataFrame, path: str, fmt: str = "parquet", *, buckets: int = BUCKETS, mode: str = "error"
) -> None:
    """Ranked clusters, partitioned by ``cluster_id % buckets``; ``fmt`` is ``parquet`` or
    ``tsv`` (item id, path, distance, cluster id)."""
    rows = _bucketed(ranked, "cluster_id", "cluster_bucket", buckets)
    if fmt == "parquet":
        rows.write.mode(mode).partitionBy("cluster_bucket").parquet(path)
    elif fmt == "tsv":
        columns = ["item_id", "path", "dist", "cluster_id", "cluster_bucket"]
        rows.select(*columns).write.mode(mode).partitionBy("cluster_bucket").csv(
            path, sep="\t", quote="", escape=""
        )
    else:
        raise ValueError(f"fmt must be 'parquet' or 'tsv', got {fmt!r}")


def read_pruning(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_pruning`` has finished below ``path``."""
    rows = spark.read.parquet(f"{path}/rows")
    finished = spark.read.parquet(f"{path}/finished")
    return join_on_keys(rows, finished, ["cluster_id", "_run"], "left_semi").drop("_run")


def unfinished(ranked: DataFrame, path: str) -> DataFrame:
    """Rows of the clusters that are not marked as finished at ``path``."""
    spark = ranked.sparkSession
    if not table_exists(spark, f"{path}/finished"):
        return ranked
    finished = spark.read.parquet(f"{path}/finished").select("cluster_id").distinct()
    return join_on_keys(ranked, finished, ["cluster_id"], "left_anti")


def write_pruning(
    ranked: DataFrame,
    path: str,
    prune: Callable[[DataFrame], DataFrame],
    *,
    resume: bool = True,
    ranges: int = 1,
) -> None:
    """Write ``prune(ranked)``; finished clusters are taken out before any comparison.

    ``ranges`` writes the clusters in so many steps, so that a stopped run can go on from
    the last step and the shuffle files of one step bound the disk in use.  A cluster counts
    as finished once a marker was written after its rows; rows of a step that failed half-way
    have no marker and ``read_pruning`` leaves them out.
    """
    todo = unfinished(ranked, path) if resume else ranked

    def step(rows: DataFrame) -> None:
        run = uuid.uuid4().hex
        pruned = prune(rows).withColumn("_run", F.lit(run))
        pruned.write.mode("append").parquet(f"{path}/rows")
        written = ranked.sparkSession.read.parquet(f"{path}/rows").where(F.col("_run") == run)
        written.select("cluster_id", "_run").distinct().write.mode("append").parquet(f"{path}/finished")

    if ranges == 1:
        step(todo)
        return
    # Written once, sorted by cluster, so that a step reads its own files only.
    todo = stage_table(todo.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id"), "todo")
    low, high = todo.agg(F.min("cluster_id"), F.max("cluster_id")).first()
    if low is not None:
        size = -(-(high - low + 1) // ranges)
        for start in range(low, high + 1, size):
            step(cluster_range(todo, start, start + size))
    no_cluster = todo.where("cluster_id IS NULL")
    if not no_cluster.isEmpty():
        step(no_cluster)


def write_stats(items: DataFrame, clusters: DataFrame, report: DataFrame, path: str, mode: str = "error") -> None:
    """Statistics per item and per cluster, and the report per eps."""
    items.write.mode(mode).parquet(f"{path}/items")
    clusters.write.mode(mode).parquet(f"{path}/clusters")
    report.write.mode(mode).parquet(f"{path}/eps_report")


def write_id_list(df: DataFrame, path: str, *, shorten: bool = False, mode: str = "error") -> None:
    """One key per line.  ``shorten`` cuts keys to the exported width."""
    key = F.col("path").cast("string")
    df.select(truncate_key(key, EXPORTED_KEY_WIDTH) if shorten else key).write.mode(mode).text(path)


def write_summary(assigned: DataFrame, path: str, mode: str = "error") -> None:
    """Summary, histogram and the size list (largest first) as tab-separated text."""
    sizes = cluster_sizes(assigned)
    tables = {
        "summary": size_summary(sizes, include_empty=True),
        "histogram": size_histogram(sizes).orderBy("size_bin"),
        "clusters_by_size": rank_clusters(assigned).orderBy("size_rank").drop("size_rank"),
    }
    for name, table in tables.items():
        table.write.mode(mode).csv(f"{path}/{name}", sep="\t", header=name == "summary")


def write_ranked_members(assigned: DataFrame, path: str, *, buckets: int = BUCKETS, mode: str = "error") -> None:
    """Members keyed by the size rank of their cluster, next to its id."""
    rows = _bucketed(ranked_members(assigned), "size_rank", "rank_bucket", buckets)
    rows.write.mode(mode).partitionBy("rank_bucket").parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "error") -> None:
    """A dataset with all its columns; partitioned by ``split`` if it has one."""
    writer = df.write.mode(mode)
    (writer.partitionBy("split") if "split" in df.columns else writer).parquet(path)
