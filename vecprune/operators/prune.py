"""The pruning core: how similar is each item to an earlier item of its cluster?

A cluster may hold a third of all rows, so no group handed to a task is a whole cluster.
Rows are cut into blocks of consecutive order positions, and the work is done on pairs of
blocks:

1. Each block is compared with itself.
2. A row whose largest similarity found so far reaches ``settle_at`` needs no more work as
   the *later* item of a pair (for unit vectors 1 cannot be exceeded; for flags it is enough
   to be above every threshold).  As long as at least half of the open rows get settled,
   the open rows of a cluster are packed together and compared again.  A flood of copies
   melts by about the block size in every round, so it never costs n² products.
3. The open rows that are left meet the earlier blocks of their cluster, which stream past
   them (``pairs``).  Where only flags are wanted, products are made only where a few leading
   coordinates leave it possible that they matter.  Where moreover the rows know their angle to a common pivot (the centroid), pairs of blocks whose
   angles are too far apart for any duplicate are left out: the angle between two vectors is
   at least the difference of their angles to a third.  In the order of the distance to the
   centroid a block covers a narrow range of angles.

No pair is ever emitted: a task returns at most one value per row it was given.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecprune.functions.names import eps_column
from vecprune.operators.joins import join_on_keys
from vecprune.operators.kernels import best_earlier, to_matrix, unit_rows
from vecprune.operators.ordinal import largest_group
from vecprune.operators.pairs import HELD, ddl_of, earlier_in_tiles, flags_in_tiles, held_for_flags, tile_blocks, tile_name
from vecprune.options import check_eps
from vecprune.staging import stage_table

# Rows of a block.  A task holds up to three blocks, in double precision 100 MB at 512
# dimensions; larger blocks mean fewer copies of a row in the shuffle.
BLOCK = 8192
UNIT_CEILING = 1.0 - 1e-12
# Angles are compared with this much allowance for rounding; near 0 and 180 degrees an error of
# 1e-15 in a cosine is one of 5e-8 in the angle.
ANGLE_MARGIN = 1e-6


def _compare_inside(keep: list[str], normalize: bool, settle_at: float | None):
    """Compare the rows of one block or pack with each other.

    With ``settle_at`` the rows are marked ``_open`` if they must go on, and only these
    carry their vector along.
    """

    def run(table: pa.Table) -> pa.Table:
        vectors = to_matrix(table["_vec"])
        if normalize:
            vectors = unit_rows(vectors)
        best = best_earlier(vectors, table["_pos"].to_numpy())
        if "_best" in table.column_names:
            best = np.maximum(best, table["_best"].to_numpy())
        out = {name: table[name] for name in keep}
        out["_best"] = pa.array(best)
        if settle_at is not None:
            # The very first block of a cluster has nothing before it but itself.
            is_open = (best < settle_at) & (table["_blk"].to_numpy() > 0)
            out["_open"] = pa.array(is_open)
            rows = pa.array(np.arange(len(best)), mask=~is_open)
            out["_vec"] = table["_vec"].combine_chunks().take(rows)
        return pa.table(out)

    return run


def _packs(blocks: DataFrame, open_rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Per block: how many open rows lie before it and in it, and the pack they go to.

    A pack is a run of blocks with at most ``2 * block`` open rows together.
    """
    counts = open_rows.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n_open"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on_keys(blocks, counts, [*keys, "_blk"], "left")
        .na.fill(0, ["_n_open"])
        .withColumn("_before", F.coalesce(F.sum("_n_open").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n_open").over(whole))
        .where("_total > 0")
        .withColumn("_pack", F.expr(f"_before div {block}"))
        .withColumn("_last_pack", F.max(F.expr("if(_n_open > 0, _pack, 0)")).over(whole))
    )


def max_earlier_sim(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("cluster_id",),
    id_col: str = "item_id",
    vec_col: str = "embedding",
    order_col: str = "order_pos",
    block: int = BLOCK,
    normalize: bool = True,
    settle_at: float | None = None,
    largest: int | None = None,
    carry: Sequence[str] = (),
    pivot_dist: str | None = None,
    levels: Sequence[float] | None = None,
) -> DataFrame:
    """``(keys, id, order, carry, max_earlier_sim)``: the largest similarity of each item to any
    item earlier in its group, 0 for the first and never below 0.

    ``order_col`` must number the rows of a cluster from 1; a group of ``keys`` may be a
    run of a cluster.  ``carry`` names narrow columns to pass through.
    Vectors are normalized first; ``normalize=False`` gives the raw inner product.
    ``settle_at`` stops the search for an item once that similarity is found, the result
    then being at least ``settle_at`` rather than the exact maximum.  With ``levels`` the result
    need only be above the same of them as the maximum; ``pivot_dist`` names a carried column with
    the cosine distance to a point that a group has in common.
    """
    keys = list(keys)
    if settle_at is None:
        settle_at = UNIT_CEILING if normalize else float("inf")
    rows = df.select(
        *keys, id_col, F.col(order_col).alias("_pos"), *carry, F.col(vec_col).alias("_vec")
    )
    narrow = [*keys, id_col, "_pos", *carry]

    def finish(out: DataFrame) -> DataFrame:
        return out.select(
            *keys,
            id_col,
            F.col("_pos").alias(order_col),
            *carry,
            # The search may stop within rounding of 1, so that is 1 whatever the path.
            (F.when(F.col("_best") >= UNIT_CEILING, F.lit(1.0)).otherwise(F.col("_best")) if normalize else F.col("_best"))
            .alias("max_earlier_sim"),
        )

    if largest is None:
        largest = largest_group(df, keys)
    if largest <= block:
        whole = _compare_inside(narrow, normalize, None)
        return finish(
            rows.groupBy(*keys).applyInArrow(whole, ddl_of(rows, narrow) + ", _best double")
        )

    # 1. Blocks against themselves.
    base = stage_table(rows.withColumn("_blk", F.expr(f"(_pos - 1) div {block}")), "blocks")
    carried = [*narrow, "_blk"]
    inside = _compare_inside(carried, normalize, settle_at)
    state_ddl = (
        f"{ddl_of(base, carried)}, _best double, _open boolean, {ddl_of(base, ['_vec'])}"
    )
    state = stage_table(base.groupBy(*keys, "_blk").applyInArrow(inside, state_ddl), "inside")
    result = [*narrow, "_best"]
    done = [state.where("not _open").select(*result)]
    flags_only = normalize and levels is not None
    prune_pairs = flags_only and pivot_dist is not None
    angle = F.acos(F.least(F.greatest(1.0 - F.col(pivot_dist), F.lit(-1.0)), F.lit(1.0))) if prune_pairs else F.lit(0.0)
    ranges = base.groupBy(*keys, "_blk").agg(F.min(angle).alias("_near"), F.max(angle).alias("_far"))
    ranges = stage_table(ranges, "ranges")
    blocks = ranges.select(*keys, "_blk")

    # 2. Packs of open rows against themselves, while that settles many.
    n_before = base.where("_blk > 0").count()
    while True:
        open_rows = state.where("_open")
        packs = stage_table(_packs(blocks, open_rows, keys, block), "packs")
        n_open, last_pack = packs.agg(
            F.coalesce(F.sum("_n_open"), F.lit(0)), F.coalesce(F.max("_last_pack"), F.lit(0))
        ).first()
        if n_open == 0 or last_pack == 0 or n_open > n_before // 2:
            break
        n_before = n_open
        packed = join_on_keys(open_rows, packs.select(*keys, "_blk", "_pack"), [*keys, "_blk"])
        state = stage_table(
            packed.groupBy(*keys, "_pack").applyInArrow(inside, state_ddl), "packed"
        )
        done.append(state.where("not _open").select(*result))

    settled = functools.reduce(DataFrame.unionByName, done)
    if n_open == 0:
        return finish(settled)

    # 3. What is still open against the earlier blocks, in runs of blocks and groups of packs
    # that fill a tile.
    held, streamed = tile_blocks(block)
    run, together = held // HELD, held
    if flags_only:
        width = base.select(F.size("_vec")).first()[0]
        number = 4 if base.schema["_vec"].dataType.simpleString() == "array<float>" else 8
        together = held_for_flags(block, largest, width * number)
    run_of = F.expr(f"_blk div {run}").alias("_run")
    runs = ranges.groupBy(*keys, run_of).agg(
        F.min("_near").alias("_near"), F.max("_far").alias("_far"), F.min("_blk").alias("_first_blk")
    )
    group_of = F.expr(f"_pack div {together}")
    of_group = join_on_keys(packs.where("_n_open > 0").withColumn("_group", group_of), ranges, [*keys, "_blk"])
    groups = of_group.groupBy(*keys, "_group").agg(
        F.min("_near").alias("_group_near"), F.max("_far").alias("_group_far"), F.max("_blk").alias("_last_blk")
    )
    reach = float(np.arccos(np.clip(min(levels), -1.0, 1.0))) + ANGLE_MARGIN if prune_pairs else float("inf")
    gap = F.greatest(F.col("_group_near") - F.col("_far"), F.col("_near") - F.col("_group_far"))
    pairs = join_on_keys(runs, groups, keys).where((F.col("_first_blk") < F.col("_last_blk")) & (gap <= reach))
    pairs = stage_table(pairs.select(*keys, "_run", "_group"), "pairs")
    tiles = pairs.withColumn("_stretch", F.expr(f"_run div {streamed // run}"))
    name = tile_name(*keys, "_group", "_stretch").alias("_tile")
    columns = [*narrow, "_vec", "_best"]
    packed = join_on_keys(open_rows, packs.select(*keys, "_blk", group_of.alias("_group")), [*keys, "_blk"])
    # A group meets a stretch of earlier runs if any of them can matter to it.
    late = join_on_keys(packed, tiles.select(*keys, "_group", "_stretch").distinct(), [*keys, "_group"])
    late = late.select(*columns, F.lit(True).alias("_held"), name)
    early = join_on_keys(base.select("*", run_of, F.lit(0.0).alias("_best")), tiles, [*keys, "_run"])
    early = early.select(*columns, F.lit(False).alias("_held"), name)
    dealt = late.unionByName(early).repartition("_tile").sortWithinPartitions("_tile", F.desc("_held"))
    kernel = flags_in_tiles(narrow, list(levels)) if flags_only else earlier_in_tiles(narrow, normalize)
    partial = dealt.mapInArrow(kernel, ddl_of(rows, narrow) + ", _best double")
    compared = (
        partial.unionByName(open_rows.select(*result))
        .groupBy(*narrow)
        .agg(F.max("_best").alias("_best"))
    )
    return finish(settled.unionByName(compared))


def flag_duplicates(df: DataFrame, eps_list: Sequence[float]) -> DataFrame:
    """One boolean column per eps: the item is more similar than ``1 - eps`` to an earlier
    one (strictly).  A larger eps flags more."""
    eps_list = check_eps(eps_list)
    flags = {eps_column(e): F.col("max_earlier_sim") > F.lit(1.0 - e) for e in eps_list}
    return df.withColumns(flags)


def prune_table(df: DataFrame, eps_list: Sequence[float], **options) -> DataFrame:
    """The flags of every eps, the cheapest way: the search for an item stops once it is a
    duplicate at the smallest eps.  So there is no ``max_earlier_sim`` here, which is a matter
    of the function of that name."""
    eps_list = check_eps(eps_list)
    if options.get("normalize", True):
        # The next number above the threshold, because the comparison is strict.
        options.setdefault("settle_at", float(np.nextafter(1.0 - min(eps_list), 2.0)))
        options.setdefault("levels", [1.0 - e for e in eps_list])
    return flag_duplicates(max_earlier_sim(df, **options), eps_list).drop("max_earlier_sim")


def select_pruned(df: DataFrame, eps: float, kept: bool = True) -> DataFrame:
    """The kept (or the removed) rows of a pruning table at one eps."""
    flag = F.col(eps_column(check_eps([eps])[0]))
    return df.where(~flag if kept else flag)
