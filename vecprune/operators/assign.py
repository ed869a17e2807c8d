"""Nearest-centroid search and distances to the own centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecprune.functions.vectors import as_double, cosine_dist, l2_sq
from vecprune.operators.kernels import to_matrix, unit_rows
from vecprune.options import check_metric
from vecprune.staging import load_or_save

# Centroids up to this size are broadcast whole; larger sets go block by block.
CENTROID_BYTES = 256 << 20
# Scores held at once by a task.
SCORE_CELLS = 4_000_000
# Scores closer than this are a tie, which goes to the lowest cluster id.
TIE = 1e-12
# Cosine distances below this are rounding noise of their own direction.
NO_DISTANCE = 1e-14
NO_CENTROID = "an item belongs to a cluster that has no centroid"
EMPTY = "the centroid table is empty"


def centroid_shape(centroids: DataFrame) -> tuple[int, int]:
    """``(number, dimension)`` of a centroid table."""
    row = centroids.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("centroid")), F.lit(0))
    ).first()
    return row[0], row[1]


def _pick(x: np.ndarray, cents: np.ndarray, half_norms: np.ndarray | None) -> np.ndarray:
    """Index of the closest centroid of each row in double precision, the first one of
    those within the tie."""
    closeness = x @ cents.T
    if half_norms is not None:
        closeness -= half_norms
    top = closeness.max(axis=1, keepdims=True)
    return np.argmax(closeness >= top - TIE, axis=1)


def _pick_fast(x, cents, half_norms, cents32, half_norms32, largest) -> np.ndarray:
    """The same result at single-precision speed: rows whose best centroid is not clear
    beyond the rounding error of the fast product are searched again."""
    closeness = x.astype(np.float32) @ cents32.T
    size = np.sqrt(np.einsum("ij,ij->i", x, x)) * largest
    if half_norms is not None:
        closeness -= half_norms32
        size = size + half_norms.max()
    pick = closeness.argmax(axis=1)
    top = closeness[np.arange(len(x)), pick]
    # Twice the worst rounding error of a sum of products, for both of the compared sums.
    margin = (x.shape[1] + 8) * 2.0**-23 * size
    rivals = np.count_nonzero(closeness >= (top - margin)[:, None], axis=1)
    unclear = np.flatnonzero(rivals > 1)
    if len(unclear):
        pick[unclear] = _pick(x[unclear], cents, half_norms)
    return pick


def _merge(found, score, picked, value, metric: str) -> None:
    """Take over what a further block of centroids has found, where it is better."""
    gain = score - value if metric == "l2" else value - score
    better = (gain > TIE) | ((np.abs(gain) <= TIE) & (picked < found))
    found[better], score[better] = picked[better], value[better]


def _nearest(shared: list, metric: str):
    """Arrow UDF returning the best of the broadcast centroids for each vector.  Centroids come
    in blocks, which every batch is multiplied with one after the other."""

    def blocks():
        for ids, matrix in shared:
            cluster_ids, cents = ids.value, matrix.value
            norms = np.einsum("ij,ij->i", cents, cents)
            half_norms = 0.5 * norms if metric == "l2" else None
            half_norms32 = half_norms.astype(np.float32) if metric == "l2" else None
            largest = float(np.sqrt(norms.max()))
            yield cluster_ids, cents, half_norms, cents.astype(np.float32), half_norms32, largest

    def search(x, block):
        cluster_ids, cents, *rest = block
        pick = _pick_fast(x, cents, *rest)
        chosen = cents[pick]
        if metric == "l2":
            gap = x - chosen
            return cluster_ids[pick], np.einsum("ij,ij->i", gap, gap)
        return cluster_ids[pick], np.einsum("ij,ij->i", x, chosen)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # One block is prepared once per task, several ones anew for each batch.
        kept = list(blocks()) if len(shared) == 1 else None
        for vectors in batches:
            found = np.full(len(vectors), np.iinfo(np.int32).max, dtype=np.int32)
            score = np.full(len(vectors), np.inf if metric == "l2" else -np.inf)
            for block in kept or blocks():
                step = max(1, SCORE_CELLS // len(block[1]))
                for lo in range(0, len(vectors), step):
                    x = to_matrix(vectors.slice(lo, step))
                    if metric == "cosine":
                        x = unit_rows(x)
                    part = slice(lo, lo + step)
                    _merge(found[part], score[part], *search(x, block), metric)
            yield pa.StructArray.from_arrays(
                [pa.array(found), pa.array(score)], names=["cluster_id", "score"]
            )

    # Declared nondeterministic so that a filter on the result is not pushed below it, which
    # would search twice.
    return F.arrow_udf(run, "cluster_id int, score double").asNondeterministic()


def _collect_block(centroids: DataFrame, metric: str):
    table = centroids.select("cluster_id", as_double("centroid").alias("centroid")).toArrow()
    table = table.sort_by("cluster_id").combine_chunks()
    ids = table.column("cluster_id").to_numpy().astype(np.int32)
    matrix = to_matrix(table.column("centroid"))
    return ids, unit_rows(matrix) if metric == "cosine" else matrix


def assign(
    df: DataFrame,
    centroids: DataFrame,
    metric: str = "cosine",
    *,
    vec_col: str = "embedding",
    limit_bytes: int = CENTROID_BYTES,
) -> DataFrame:
    """Add ``cluster_id`` and ``score`` of the nearest centroid.

    ``cosine`` normalizes both sides, ``ip`` is the raw inner product, ``l2`` the squared
    distance.  Ties go to the lowest cluster id.  No (item, centroid) row is ever made:
    each Arrow batch is multiplied with the broadcast centroids.  Centroids larger than
    ``limit_bytes`` go in several broadcasts; the items are read once in any case.
    """
    check_metric(metric)
    sc = df.sparkSession.sparkContext
    number, dim = centroid_shape(centroids)
    names = [c for c in df.columns if c not in ("cluster_id", "score")]
    if number == 0:
        # No items, no result; an item cannot be assigned.
        no_id, no_score = (F.raise_error(F.lit(EMPTY)).cast(t) for t in ("int", "double"))
        return df.select(*names, no_id.alias("cluster_id"), no_score.alias("score"))
    n_blocks = -(-number * dim * 8 // limit_bytes)
    shared = []
    for b in range(n_blocks):
        part = centroids
        if n_blocks > 1:
            part = centroids.where(F.pmod(F.hash("cluster_id"), F.lit(n_blocks)) == b)
        ids, matrix = _collect_block(part, metric)
        if len(ids):
            shared.append((sc.broadcast(ids), sc.broadcast(matrix)))
    out = df.withColumn("_near", _nearest(shared, metric)(F.col(vec_col)))
    return out.select(*names, "_near.cluster_id", "_near.score")


def join_centroids(
    df: DataFrame, centroids: DataFrame, *, limit_bytes: int = CENTROID_BYTES
) -> DataFrame:
    """Each row with the ``centroid`` of its cluster, and an error if there is none; broadcast
    if it was measured to fit, else a shuffle join whose hot clusters AQE splits."""
    number, dim = centroid_shape(centroids)
    side = centroids.select("cluster_id", "centroid")
    if number * dim * 8 <= limit_bytes:
        side = F.broadcast(side)
    own = F.when(F.col("centroid").isNull(), F.raise_error(F.lit(NO_CENTROID))).otherwise(F.col("centroid"))
    return df.join(side, "cluster_id", "left").withColumn("centroid", own)


def _own_distance(shared_ids, shared_matrix, metric: str):
    """Arrow UDF: distance of each vector to the broadcast centroid of its cluster."""

    def run(vectors: pa.Array, clusters: pa.Array) -> pa.Array:
        ids, cents = shared_ids.value, shared_matrix.value
        wanted = clusters.to_numpy(zero_copy_only=False)
        if len(wanted) and not len(ids):
            raise ValueError(NO_CENTROID)
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        if (ids[at] != wanted).any():
            raise ValueError(NO_CENTROID)
        x = to_matrix(vectors)
        if metric == "l2":
            gap = x - cents[at]
            return pa.array(np.einsum("ij,ij->i", gap, gap))
        return pa.array(1.0 - np.einsum("ij,ij->i", unit_rows(x), cents[at]))

    return F.arrow_udf(run, "double").asNondeterministic()


def dist_to_centroid(
    df: DataFrame,
    centroids: DataFrame | None = None,
    metric: str = "cosine",
    *,
    spherical: bool = True,
    vec_col: str = "embedding",
    limit_bytes: int = CENTROID_BYTES,
) -> DataFrame:
    """Add ``dist``, the distance to the own centroid.

    Without ``centroids`` it is derived from the stored ``score``: a similarity for spherical
    clustering, otherwise a squared distance, from which no cosine follows.  With them it is
    computed:
    ``1 - cosine``, or the squared L2 distance.  Centroids are broadcast if they were
    measured to fit ``limit_bytes``, else joined.
    """
    check_metric(metric, spherical)
    if centroids is None:
        if not spherical and metric != "l2":
            raise ValueError("a cosine distance cannot be derived from the score of plain k-means")
        return df.withColumn("dist", _clean(1.0 - F.col("score")) if spherical else F.col("score"))
    number, dim = centroid_shape(centroids)
    if number * dim * 8 <= limit_bytes:
        sc = df.sparkSession.sparkContext
        ids, matrix = _collect_block(centroids, "l2" if metric == "l2" else "cosine")
        distance = _own_distance(sc.broadcast(ids), sc.broadcast(matrix), metric)
        dist = distance(F.col(vec_col), F.col("cluster_id"))
        if metric == "l2":
            return df.withColumn("dist", dist)
        return df.withColumn("_dist", dist).withColumn("dist", _clean(F.col("_dist"))).drop("_dist")
    joined = df.join(centroids.select("cluster_id", "centroid"), "cluster_id", "left")
    measure = l2_sq if metric == "l2" else cosine_dist
    checked = F.when(F.col("centroid").isNull(), F.raise_error(F.lit(NO_CENTROID))).otherwise(
        measure(vec_col, "centroid")
    )
    return joined.withColumn("dist", checked if metric == "l2" else _clean(checked)).drop("centroid")


def _clean(dist: Column) -> Column:
    """A cosine distance without the rounding noise around 0, which differs by kernel."""
    return F.when(F.abs(dist) < NO_DISTANCE, F.lit(0.0)).otherwise(dist)


def load_or_assign(path: str, df: DataFrame, centroids: DataFrame, metric: str = "cosine", **options):
    """The assignments saved at ``path``; computed and saved there if there are none, also
    where a save died half-way."""
    return load_or_save(df.sparkSession, path, lambda: assign(df, centroids, metric, **options))
