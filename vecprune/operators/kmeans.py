"""K-means training."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecprune.functions.hashing import seeded_hash
from vecprune.functions.vectors import as_double, l2_normalize, squared_norm
from vecprune.operators.assign import CENTROID_BYTES, assign
from vecprune.operators.bounds import Round, bounded_rounds
from vecprune.operators.kernels import to_lists, to_matrix, unit_rows
from vecprune.operators.sums import vector_sums
from vecprune.staging import drop_stage, load_or_save, stage_table

HASH_STEPS = 10**12


def first_centroids(
    df: DataFrame,
    k: int,
    seed: int = 1234,
    spherical: bool = True,
    *,
    id_col: str = "item_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``k`` different vectors to start from: those with the lowest seeded hash of an id (then
    the lowest id), numbered from 0 in this order.  There are fewer if there are fewer
    different vectors.  Spherical clustering skips zero vectors, which have no direction.

    Only rows below a bound on the hash are compared with each other, as many as are expected
    to hold ``k`` different vectors; the bound is raised until they do, so the answer does not
    depend on it.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))
    rows = rows.withColumn("_hash", seeded_hash(seed, "_id"))
    if spherical:
        rows = rows.where(squared_norm("_vec") > 0.0)
    n, wanted = rows.count(), 4 * k
    while True:
        some = rows if wanted >= n else rows.where(F.col("_hash") % HASH_STEPS < HASH_STEPS * wanted // n)
        order = F.struct(F.col("_hash") % HASH_STEPS, "_hash", "_id")
        distinct = stage_table(some.groupBy("_vec").agg(F.min(order).alias("_order")), "starts")
        if wanted >= n or distinct.count() >= k:
            break
        drop_stage(distinct)
        wanted *= 4
    # At most k rows are numbered, as many as there will be centroids.
    chosen = distinct.orderBy("_order").limit(k)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_order")) - 1
    vector = l2_normalize("_vec") if spherical else as_double("_vec")
    return stage_table(
        chosen.select(number.cast("int").alias("cluster_id"), vector.alias("centroid")), "centroids"
    )


def fit_kmeans(
    df: DataFrame,
    k: int,
    niter: int = 100,
    seed: int = 1234,
    spherical: bool = True,
    *,
    id_col: str = "item_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Train on every row and return the centroid table (it may have fewer than ``k`` rows).

    ``first_centroids`` and then ``niter`` rounds of ``lloyd``: no random choice but the seeded
    hash, and nothing on the driver that grows faster than the centroids.
    """
    init = first_centroids(df, k, seed, spherical, id_col=id_col, vec_col=vec_col)
    return lloyd(df, init, niter, spherical, vec_col=vec_col)


def mean_centroids(
    df: DataFrame, spherical: bool = True, *, cluster_col: str = "cluster_id", vec_col: str = "embedding"
) -> DataFrame:
    """Centroid table of given clusters: the mean of the (normalized) vectors, itself
    normalized for spherical clustering.  Tasks add up their rows before the shuffle."""
    rows = df.select(F.col(cluster_col).cast("int").alias("cluster_id"), vec_col)
    sums = vector_sums(rows, ["cluster_id"], vec_col, normalize=spherical)
    mean = F.transform("_sum", lambda x: x / F.col("_n"))
    return sums.select(
        "cluster_id", (l2_normalize("_sum") if spherical else mean).alias("centroid")
    )


def lloyd(
    df: DataFrame,
    init: DataFrame,
    niter: int,
    spherical: bool = True,
    *,
    vec_col: str = "embedding",
    limit_bytes: int = CENTROID_BYTES,
    report: Callable[[Round], None] | None = None,
) -> DataFrame:
    """``niter`` rounds of assign-and-average from the given centroids, without any random
    choice.  A cluster that loses all its items keeps its old centroid.

    Bounds on distances spare products that cannot matter (``bounds``); ``report`` is told how
    many.  Centroids beyond ``limit_bytes`` are searched block by block without bounds.
    """
    number, dim = init.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("centroid")), F.lit(0))).first()
    if number == 0 or niter == 0:
        return init.select("cluster_id", "centroid")
    if number * dim * 8 > limit_bytes:
        return searched_rounds(df, init, niter, spherical, vec_col=vec_col, limit_bytes=limit_bytes)
    table = init.select("cluster_id", as_double("centroid").alias("centroid")).toArrow()
    table = table.sort_by("cluster_id").combine_chunks()
    matrix = to_matrix(table.column("centroid"))
    ids = table.column("cluster_id").to_numpy()
    start = unit_rows(matrix) if spherical else matrix
    vectors = df.select(F.col(vec_col).alias("vec"))
    found, kept = bounded_rounds(vectors, ids, start, niter, spherical, report)
    # A centroid that no item has ever joined is the given one.
    found[kept] = matrix[kept]
    made = pa.table({"cluster_id": table.column("cluster_id"), "centroid": pa.chunked_array([to_lists(found)])})
    return stage_table(df.sparkSession.createDataFrame(made), "centroids")


def searched_rounds(
    df: DataFrame,
    init: DataFrame,
    niter: int,
    spherical: bool = True,
    *,
    vec_col: str = "embedding",
    limit_bytes: int = CENTROID_BYTES,
) -> DataFrame:
    """The same rounds by a search through all centroids."""
    metric = "cosine" if spherical else "l2"
    vectors = df.select(F.col(vec_col))
    if spherical:
        vectors = stage_table(vectors.where(squared_norm(vec_col) > 0.0), "vectors")
    cents = init.select("cluster_id", "centroid")
    for done in range(niter):
        before = cents
        near = assign(vectors, cents, metric, vec_col=vec_col, limit_bytes=limit_bytes)
        moved = mean_centroids(near, spherical, vec_col=vec_col).withColumnRenamed("centroid", "_moved")
        cents = stage_table(
            cents.join(moved, "cluster_id", "left").select(
                "cluster_id", F.coalesce("_moved", as_double("centroid")).alias("centroid")
            ),
            "lloyd",
        )
        if done:
            drop_stage(before)
    return cents


def load_or_fit(path: str, df: DataFrame, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The centroids saved at ``path``; trained by ``fit(df)`` and saved if there are none.

    A save that died half-way is no table: training starts again and takes its place."""
    return load_or_save(df.sparkSession, path, lambda: fit(df))
