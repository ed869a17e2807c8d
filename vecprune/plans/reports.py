"""Reports over clusters and over a pruning run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.functions.vectors import l2_normalize, squared_norm
from vecprune.operators.joins import join_on_keys
from vecprune.operators.pairs import pair_stats
from vecprune.operators.prune import BLOCK, UNIT_CEILING, flag_duplicates
from vecprune.operators.sizes import cluster_sizes, rank_clusters, size_histogram, size_summary
from vecprune.operators.stats import (
    avg_sim_to_others,
    centroid_cohesion,
    duplicate_report,
    eps_sweep,
    pairwise_std,
)
from vecprune.operators.validate import split_valid
from vecprune.options import check_eps
from vecprune.sources.writers import read_pruning, write_pruning
from vecprune.staging import stage_table


def cluster_report(df: DataFrame) -> dict[str, DataFrame]:
    """Summary, histogram and clusters by size of rows ``(item_id, cluster_id)``."""
    sizes = cluster_sizes(df)
    return {
        "summary": size_summary(sizes, include_empty=True),
        "histogram": size_histogram(sizes),
        "clusters": rank_clusters(df),
    }


def item_stats(rows: DataFrame, eps_list: Sequence[float], keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Similarities and flags per item of usable rows ``(keys, item_id, order_pos, embedding)``.

    One pass over the pairs of a group gives the largest similarity to an earlier item and both
    extremes.  Exact copies go through it once, whatever their number: the first of them in the
    order stands for all, and a later one is as similar to it as it is to itself.
    """
    keys = list(keys)
    prints = {"_print": F.xxhash64("embedding"), "_print2": F.xxhash64(F.lit(1), "embedding")}
    same = [*keys, *prints]
    marked = stage_table(rows.select(*keys, "item_id", "order_pos", "embedding").withColumns(prints), "marked")
    copies = marked.groupBy(*same).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min("order_pos").alias("_pos"),
        F.min("embedding").alias("_vec"),
        F.max("embedding").alias("_top"),
    )
    clash = F.raise_error(F.lit("two vectors share their 128-bit hash"))
    one = F.when(F.col("_vec").eqNullSafe(F.col("_top")), F.col("_vec")).otherwise(clash)
    own = squared_norm(l2_normalize("_vec")).alias("_own")
    distinct = stage_table(
        copies.select(*same, "_copies", "_pos", one.alias("_vec"))
        .withColumn("_blk", F.expr(f"(_pos - 1) div {block}")).select("*", own),
        "distinct",
    )
    groups = distinct.groupBy(*keys).agg(
        F.sum("_copies").alias("_n"), F.count(F.lit(1)).alias("_rows"), (F.max("_blk") + 1).alias("_nb")
    )
    groups = stage_table(groups, "groups")
    largest = groups.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0]
    placed = join_on_keys(distinct.select(*keys, "_pos", "_blk", "_vec"), groups.select(*keys, "_nb"), keys)
    placed = placed.withColumn("_first", F.col("_pos"))
    placed = stage_table(placed, "placed") if largest > block else placed
    found = pair_stats(placed, keys, "_first", largest, block)
    found = join_on_keys(found, groups.select(*keys, "_n"), keys)
    narrow = distinct.drop("_vec", "_blk").withColumnRenamed("_pos", "_first")
    found = join_on_keys(narrow, found, [*keys, "_first"])
    # No vector takes part; a hot one makes a side of this join skewed, which AQE splits.
    back = join_on_keys(marked.drop("embedding"), found, same)
    among_copies = F.when(F.col("_copies") > 1, F.col("_own"))
    earlier = F.when(F.col("order_pos") > F.col("_first"), F.greatest("_best", "_own")).otherwise(F.col("_best"))
    alone = F.col("_n") == 1
    items = back.select(
        *keys, "item_id", "order_pos",
        F.when(earlier >= UNIT_CEILING, F.lit(1.0)).otherwise(earlier).alias("max_earlier_sim"),
        F.when(~alone, F.greatest("_max", among_copies)).alias("max_sim"),
        F.when(~alone, F.col("_min")).alias("min_sim"),
    )
    return flag_duplicates(items, eps_list)


def cluster_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size, cohesion and spread per cluster; the spread of a cut cluster is the mean of its parts."""
    spread = pairwise_std(rows, keys=list(keys))
    per_cluster = spread.groupBy("cluster_id").agg(
        F.sum("cluster_size").alias("cluster_size"), F.avg("std_pair_sim").alias("std_pair_sim")
    )
    return join_on_keys(per_cluster, centroid_cohesion(rows), ["cluster_id"])


def _comparable(ordered: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    keys = ["cluster_id", "part"] if "part" in ordered.columns else ["cluster_id"]
    usable, rejects = split_valid(ordered.select(*keys, "item_id", "order_pos", "dist", "embedding"))
    return keys, usable, rejects


def _all_items(rows: DataFrame, eps_list: Sequence[float], keys: list[str], block: int) -> DataFrame:
    """``item_stats`` with the mean similarity to the others.  A position is in a group once,
    while an id may stand in two clusters."""
    means = avg_sim_to_others(rows, keys=keys).select(*keys, "order_pos", "avg_sim_to_others")
    return join_on_keys(item_stats(rows, eps_list, keys, block), means, [*keys, "order_pos"])


def prune_report(
    ordered: DataFrame, eps_list: Sequence[float], *, block: int = BLOCK
) -> dict[str, DataFrame]:
    """Statistics of ordered clusters ``(item_id, cluster_id, dist, order_pos, embedding)``, the
    distance being the cosine distance to the centroid, with ``part`` if they were cut:

    ``items``: similarity to earlier items, flags, mean and extreme similarities;
    ``clusters``: size, cohesion and spread; ``eps_report``: duplicates per eps and cluster;
    ``sweep``: kept fraction per eps; ``rejects``: rows that cannot be compared, which no other
    table counts.
    """
    eps_list = check_eps(eps_list)
    keys, usable, rejects = _comparable(ordered)
    rows = stage_table(usable, "report")
    items = stage_table(_all_items(rows, eps_list, keys, block), "items")
    return {
        "items": items,
        "clusters": cluster_stats(rows, keys),
        "eps_report": duplicate_report(items, eps_list),
        "sweep": eps_sweep(items, eps_list),
        "rejects": rejects,
    }


def write_report(
    ordered: DataFrame,
    path: str,
    eps_list: Sequence[float],
    *,
    block: int = BLOCK,
    ranges: int = 1,
    resume: bool = True,
) -> dict[str, DataFrame]:
    """``prune_report`` written below ``path``, cluster by cluster: a run that was stopped goes
    on with the clusters that are not marked as finished.

    ``ranges`` is the number of steps; the tables per eps come from the finished items.  The eps
    values of a resumed run must be those it began with.
    """
    eps_list = check_eps(eps_list)
    spark = ordered.sparkSession
    keys, usable, rejects = _comparable(ordered)
    rows = stage_table(usable, "report")
    steps = {
        "items": lambda some: _all_items(some, eps_list, keys, block),
        "clusters": lambda some: cluster_stats(some, keys),
    }
    for name, make in steps.items():
        write_pruning(rows, f"{path}/{name}", make, resume=resume, ranges=ranges)
    items = read_pruning(spark, f"{path}/items")
    return {
        "items": items,
        "clusters": read_pruning(spark, f"{path}/clusters"),
        "eps_report": duplicate_report(items, eps_list),
        "sweep": eps_sweep(items, eps_list),
        "rejects": rejects,
    }
