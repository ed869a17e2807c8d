"""Similarity statistics per item and per cluster.

What can be had from sums is had from sums: means from the vector sum of a cluster, the
spread of the whole similarity matrix from its Gram matrix.  Only the extreme values need
pairs, and they are taken on block pairs like the pruning itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecprune.functions.hashing import seeded_hash
from vecprune.functions.names import eps_column
from vecprune.functions.vectors import as_double, dot, l2_normalize, squared_norm
from vecprune.operators.assign import CENTROID_BYTES
from vecprune.operators.joins import join_on_keys
from vecprune.operators.kernels import to_matrix, unit_rows
from vecprune.operators.ordinal import largest_group
from vecprune.operators.pairs import pair_stats
from vecprune.operators.prune import BLOCK
from vecprune.operators.rank import with_group_size
from vecprune.operators.sums import vector_sums
from vecprune.options import check_eps
from vecprune.staging import stage_table

GRAM_ROWS = 16384


def avg_sim_to_others(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("cluster_id",),
    vec_col: str = "embedding",
    normalize: bool = True,
    limit_bytes: int = CENTROID_BYTES,
) -> DataFrame:
    """Add ``avg_sim_to_others``: mean similarity to the other members, NULL if alone.

    ``(x·Σ - x·x) / (n - 1)`` with Σ the vector sum of the group: linear, no pairs.
    """
    keys = list(keys)
    unit = df.withColumn("_u", l2_normalize(vec_col) if normalize else as_double(vec_col))
    sums = stage_table(vector_sums(df, keys, vec_col, normalize), "sums")
    groups, dim = sums.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_sum")), F.lit(0))).first()
    side = F.broadcast(sums) if groups * dim * 8 <= limit_bytes else sums
    others = (dot("_u", "_sum") - squared_norm("_u")) / F.nullif(F.col("_n") - 1, F.lit(0))
    return join_on_keys(unit, side, keys).withColumn("avg_sim_to_others", others).drop("_u", "_sum", "_n")


def extreme_sims(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("cluster_id",),
    id_col: str = "item_id",
    vec_col: str = "embedding",
    block: int = BLOCK,
    normalize: bool = True,
    largest: int | None = None,
) -> DataFrame:
    """``(keys, id, max_sim, min_sim)``: largest and smallest similarity to another member.
    The zero diagonal counts, so the maximum is at least and the minimum at most 0; both
    are NULL for an item that is alone.

    Rows are salted into blocks of about ``block`` rows by a hash of the id, whose pairs go
    through tasks in tiles.  If some group exceeds a block, exact copies
    are compared once, whatever their number.
    """
    keys = list(keys)
    rows = df.select(*keys, id_col, F.col(vec_col).alias("_vec"))
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= block:
        extremes = _extremes_of(rows, keys, id_col, block, normalize, largest)
        return extremes.select(*keys, id_col, *_high_and_low(F.col("_n") == 1, None))

    # The copies are counted where they lie, before the vectors are shuffled; two hashes stand
    # for a vector, and different vectors with both in common end the job.
    same = [*keys, "_print", "_print2"]
    rows = rows.withColumns({"_print": F.xxhash64("_vec"), "_print2": F.xxhash64(F.lit(1), "_vec")})
    grouped = rows.groupBy(*same).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min(id_col).alias(id_col),
        F.min("_vec").alias("_vec"),
        F.max("_vec").alias("_top"),
    )
    clash = F.raise_error(F.lit("two vectors share their 128-bit hash"))
    one = F.when(F.col("_vec").eqNullSafe(F.col("_top")), F.col("_vec")).otherwise(clash)
    distinct = stage_table(grouped.withColumn("_vec", one).drop("_top"), "distinct")
    extremes = _extremes_of(distinct.drop("_copies", "_print", "_print2"), keys, id_col, block, normalize, largest)
    length = squared_norm(l2_normalize("_vec") if normalize else as_double("_vec")).alias("_own")
    narrow = distinct.select(*same, id_col, "_copies", length)
    found = join_on_keys(narrow, extremes, [*keys, id_col]).drop(id_col)
    # No vector takes part; a hot one makes a side of this join skewed, which AQE splits.
    back = join_on_keys(rows.drop("_vec"), found, same)
    own = F.col("_own")
    alone = (F.col("_n") == 1) & (F.col("_copies") == 1)
    return back.select(*keys, id_col, *_high_and_low(alone, F.when(F.col("_copies") > 1, own)))


def _high_and_low(alone: Column, among_copies: Column | None) -> list[Column]:
    """The two results, NULL for an item that is alone."""
    high, low = F.col("_max"), F.col("_min")
    if among_copies is not None:
        high = F.greatest(high, among_copies)
    return [F.when(~alone, high).alias("max_sim"), F.when(~alone, low).alias("min_sim")]


def _extremes_of(
    rows: DataFrame, keys: list[str], id_col: str, block: int, normalize: bool, largest: int
) -> DataFrame:
    """``(keys, id, _n, _max, _min)`` over all pairs of each group."""
    sized = with_group_size(rows, keys, "_n")
    sized = sized.withColumn("_nb", F.expr(f"(_n + {block} - 1) div {block}"))
    # Without an order, a row's number only tells it from others.
    placed = sized.withColumn("_blk", seeded_hash(0, id_col) % F.col("_nb")).withColumn(
        "_pos", F.monotonically_increasing_id()
    )
    placed = stage_table(placed, "placed") if largest > block else placed
    found = pair_stats(placed, [*keys, "_n"], id_col, largest, block, normalize)
    return found.drop("_best")


def _moments(keys: list[str], normalize: bool):
    def run(table: pa.Table) -> pa.Table:
        x = to_matrix(table["_vec"])
        if normalize:
            x = unit_rows(x)
        own = np.einsum("ij,ij->i", x, x)
        total = x.sum(axis=0)
        whole = table["_chunks"][0].as_py() == 1
        if whole:
            # The smaller of the two products has the same sum of squares.
            square = x @ x.T if len(x) < x.shape[1] else x.T @ x
            squares, gram = float((square * square).sum()), None
        else:
            squares, gram = 0.0, (x.T @ x).ravel()
        first = table.slice(0, 1).select(keys)
        values = {
            "_n": pa.array([len(x)], pa.int64()),
            "_own": pa.array([float(own.sum())]),
            "_own_sq": pa.array([float((own * own).sum())]),
            "_squares": pa.array([squares]),
            "_total": pa.array([total], pa.list_(pa.float64())),
            "_gram": pa.array([gram], pa.list_(pa.float64())),
        }
        for name, value in values.items():
            first = first.append_column(name, value)
        return first

    return run


def pairwise_std(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("cluster_id",),
    id_col: str = "item_id",
    vec_col: str = "embedding",
    normalize: bool = True,
    chunk: int = GRAM_ROWS,
) -> DataFrame:
    """``(keys, cluster_size, std_pair_sim)``: spread of all n² entries of the similarity
    matrix with a zero diagonal, divisor n² - 1; NULL for a single item.

    Linear in the rows: the sum of the entries is ``|Σx|²`` and the sum of their squares
    the squared Frobenius norm of ``XᵀX``, which adds up over chunks of a group.
    """
    keys = list(keys)
    rows = with_group_size(
        df.select(*keys, id_col, F.col(vec_col).alias("_vec")), keys, "_size"
    ).withColumn("_chunks", F.expr(f"(_size + {chunk} - 1) div {chunk}"))
    salted = rows.withColumn("_chunk", seeded_hash(0, id_col) % F.col("_chunks"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in keys)
    ddl += (
        ", _n bigint, _own double, _own_sq double, _squares double,"
        " _total array<double>, _gram array<double>"
    )
    parts = salted.groupBy(*keys, "_chunk").applyInArrow(_moments(keys, normalize), ddl)
    nothing = F.array(F.lit(0.0))
    merged = parts.groupBy(*keys).agg(
        F.sum("_n").alias("_n"),
        F.sum("_own").alias("_own"),
        F.sum("_own_sq").alias("_own_sq"),
        F.sum("_squares").alias("_squares"),
        vector_to_array(Summarizer.sum(array_to_vector("_total"))).alias("_total"),
        vector_to_array(
            Summarizer.sum(array_to_vector(F.coalesce("_gram", nothing)))
        ).alias("_gram"),
    )
    n2 = F.col("_n").cast("double") * F.col("_n")
    total = squared_norm("_total") - F.col("_own")
    squares = F.col("_squares") + squared_norm("_gram") - F.col("_own_sq")
    # Rounding may leave a tiny negative rest where all entries are equal.
    variance = F.greatest(squares - total * total / n2, F.lit(0.0)) / F.nullif(n2 - 1.0, F.lit(0.0))
    return merged.select(
        *keys, F.col("_n").alias("cluster_size"), F.sqrt(variance).alias("std_pair_sim")
    )


def centroid_cohesion(df: DataFrame, *, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Mean and population std of the similarity to the centroid, from ``dist``."""
    sim = 1.0 - F.col("dist")
    return df.groupBy(*keys).agg(
        F.avg(sim).alias("avg_sim_to_cent"), F.stddev_pop(sim).alias("std_sim_to_cent")
    )


def _per_eps(wide: DataFrame, eps_list: Sequence[float], value_prefix: str, value: str) -> DataFrame:
    """Columns ``{prefix}0..`` of an aggregated table as rows with an ``eps`` column."""
    pairs = ", ".join(f"{e!r}D, `{value_prefix}{i}`" for i, e in enumerate(eps_list))
    others = [c for c in wide.columns if not c.startswith(value_prefix)]
    return wide.select(*others, F.expr(f"stack({len(eps_list)}, {pairs}) as (eps, {value})"))


def duplicate_report(df: DataFrame, eps_list: Sequence[float]) -> DataFrame:
    """``(eps, cluster_id, cluster_size, num_duplicates, duplicates_ratio)``, ratio in
    percent.  All eps are counted in one aggregate; only its result is turned to rows."""
    eps_list = check_eps(eps_list)
    wide = df.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        *[F.count_if(eps_column(e)).alias(f"_dup{i}") for i, e in enumerate(eps_list)],
    )
    ratio = F.lit(100.0) * F.col("num_duplicates") / F.col("cluster_size")
    return _per_eps(wide, eps_list, "_dup", "num_duplicates").select(
        "eps", "cluster_id", "cluster_size", "num_duplicates", ratio.alias("duplicates_ratio")
    )


def eps_sweep(df: DataFrame, eps_list: Sequence[float]) -> DataFrame:
    """``(eps, kept_fraction)`` over all items, from one scan."""
    eps_list = check_eps(eps_list)
    wide = df.agg(
        *[F.avg((~F.col(eps_column(e))).cast("double")).alias(f"_kept{i}") for i, e in enumerate(eps_list)]
    )
    return _per_eps(wide, eps_list, "_kept", "kept_fraction")


def kept_count(df: DataFrame, eps: float) -> DataFrame:
    """One row: items kept and removed at one eps."""
    flag = F.col(eps_column(check_eps([eps])[0]))
    return df.agg(F.count_if(~flag).alias("n_kept"), F.count_if(flag).alias("n_removed"))
