"""Whole jobs: items to kept items.

Every job sets bad rows aside first: a vector that is NULL, odd-sized or not finite, or a NULL
cluster where clusters are given.  Jobs return the result and these rejects, so that one bad
row neither ends a long run nor disappears.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.operators.assign import assign, dist_to_centroid
from vecprune.operators.encode import embed, hash_encoder
from vecprune.operators.gather import keep_items
from vecprune.operators.kmeans import fit_kmeans, mean_centroids
from vecprune.operators.ordinal import HOT_ROWS, largest_group, ordinal
from vecprune.operators.prune import prune_table, select_pruned
from vecprune.operators.rank import order_policy, rank_within_cluster, split_clusters
from vecprune.operators.joins import join_on_keys
from vecprune.operators.validate import split_valid
from vecprune.options import DedupOptions
from vecprune.staging import stage_table


INT_TYPES = ("tinyint", "smallint", "int")


class Outcome(NamedTuple):
    """Rows of a job, and its rejects with a ``reason``."""

    rows: DataFrame
    rejects: DataFrame


def ordered_clusters(
    df: DataFrame, options: DedupOptions, *, largest: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows ``(item_id, cluster_id, dist, ...)`` with ``pos``, ``order_pos`` and, if big
    clusters are to be cut, ``part``."""
    if largest is None:
        largest = largest_group(df, ["cluster_id"])
    size = {"largest": largest, "hot_rows": hot_rows}
    ranked = rank_within_cluster(df, options.keep_hard, **size)
    ordered = order_policy(ranked, options.which, options.seed, **size)
    if options.max_cluster_size is not None:
        ordered = split_clusters(ordered, options.max_cluster_size)
    return ordered


def prune_clusters(df: DataFrame, options: DedupOptions, *, largest: int | None = None) -> DataFrame:
    """Pruning table of rows ``(item_id, cluster_id, dist, embedding)``."""
    if largest is None:
        largest = largest_group(df, ["cluster_id"])
    ordered = ordered_clusters(df, options, largest=largest)
    keys = ["cluster_id"]
    if options.max_cluster_size is not None:
        keys.append("part")
        largest = min(largest, options.max_cluster_size)
    return prune_table(
        ordered,
        options.eps_list,
        keys=keys,
        block=options.block,
        largest=largest,
        carry=["pos", "dist"],
        pivot_dist="dist" if options.metric == "cosine" else None,
    )


def number_clusters(df: DataFrame, cluster_col: str) -> DataFrame:
    """``df`` with ``cluster_id`` (INT) for a cluster key of any type.

    INT keys are taken as they are, other keys are numbered in their order, so that no two of
    them meet.  NULL stays NULL.
    """
    if df.schema[cluster_col].dataType.simpleString() in INT_TYPES:
        return df.withColumn("cluster_id", F.col(cluster_col).cast("int"))
    keys = df.select(F.col(cluster_col).alias("_key")).where("_key IS NOT NULL").distinct()
    numbered = stage_table(ordinal(stage_table(keys, "keys"), [F.col("_key").asc()], name="_no"), "numbers")
    number = numbered.select(F.col("_key").alias(cluster_col), (F.col("_no") - 1).cast("int").alias("cluster_id"))
    return join_on_keys(df.drop(*{"cluster_id"} - {cluster_col}), number, [cluster_col], "left")


def with_rejects(df: DataFrame, vec_col: str = "embedding", dim: int | None = None) -> Outcome:
    """Usable rows and rejects of ``(..., cluster_id, embedding)``; ``cluster_id`` is optional."""
    usable, rejects = split_valid(df, vec_col, dim)
    if "cluster_id" in df.columns:
        lost = usable.where("cluster_id IS NULL").withColumn("reason", F.lit("no cluster"))
        usable, rejects = usable.where("cluster_id IS NOT NULL"), rejects.unionByName(lost)
    return Outcome(usable, rejects)


def dedup_given_clusters(
    df: DataFrame,
    options: DedupOptions,
    *,
    cluster_col: str = "cluster_id",
    centroids: DataFrame | None = None,
    dim: int | None = None,
) -> Outcome:
    """Pruning table of rows ``(item_id, <cluster_col>, embedding)``, and the rejects; the
    centroids default to the means of the clusters.  Keys that are no INT are numbered within
    the job and come back as ``cluster_key``."""
    rows = df.select("item_id", F.col(cluster_col).alias("cluster_key"), "embedding")
    numbered = number_clusters(rows, "cluster_key")
    named = df.schema[cluster_col].dataType.simpleString() not in INT_TYPES
    if named:
        # Read twice: for the job, and for the keys of its result.
        numbered = stage_table(numbered, "numbered")
        keys = numbered.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.first("cluster_key").alias("cluster_key"))
    else:
        numbered = numbered.drop("cluster_key")
    usable, rejects = with_rejects(numbered, dim=dim)
    members = usable.select("item_id", "cluster_id", "embedding")
    if centroids is None:
        centroids = stage_table(mean_centroids(members, options.spherical), "centroids")
    measured = dist_to_centroid(members, centroids, options.metric, spherical=options.spherical)
    pruned = prune_clusters(measured, options)
    return Outcome(join_on_keys(pruned, keys, ["cluster_id"]) if named else pruned, rejects)


def cluster_items(items: DataFrame, options: DedupOptions, centroids: DataFrame | None = None) -> DataFrame:
    """Rows ``(item_id, embedding)`` with ``cluster_id`` and ``dist``, staged.

    The distance follows from the score of the search, except for a cosine after plain k-means,
    whose score is a squared distance: that one is computed from the centroids.
    """
    if centroids is None:
        centroids = fit_kmeans(items, options.k, options.niter, options.seed, options.spherical)
    metric = "cosine" if options.spherical else "l2"
    assigned = assign(items, centroids, metric)
    derived = options.spherical or options.metric == "l2"
    measured = dist_to_centroid(
        assigned, None if derived else centroids, options.metric, spherical=options.spherical
    )
    return stage_table(measured.drop("score"), "clustered")


def dedup(
    df: DataFrame,
    options: DedupOptions,
    *,
    id_col: str = "item_id",
    content_col: str = "text",
    dim: int = 256,
    make_encoder: Callable | None = None,
    eps: float | None = None,
) -> Outcome:
    """The rows of ``df`` kept at ``eps`` (default: the first of the list), and as rejects
    ``(item_id, embedding, reason)`` of those whose encoding cannot be used.

    Embed, cluster, rank, prune; the payload itself is read only by the last join.
    """
    eps = options.eps_list[0] if eps is None else eps
    if eps not in options.eps_list:
        raise ValueError(f"eps {eps} is not in the list {options.eps_list}")
    if make_encoder is None:
        encoded = hash_encoder(df.select(id_col, content_col), content_col, dim, normalize=False)
    else:
        encoded = embed(df, id_col, content_col, make_encoder)
    items = stage_table(encoded.select(F.col(id_col).alias("item_id"), "embedding"), "encoded")
    usable, rejects = with_rejects(items)
    pruned = prune_clusters(cluster_items(usable, options), options)
    kept = select_pruned(pruned, eps).select(F.col("item_id").alias(id_col))
    return Outcome(keep_items(df, kept, id_col=id_col, path_col=None), rejects)
