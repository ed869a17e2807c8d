"""Rounds of k-means that multiply a vector only with centroids that could be nearest.

By the triangle inequality a centroid that has moved by ``m`` since a vector's distance to it
was known to be at least ``b`` is still at least ``b - m`` away.  The state of a vector is its
centroid and, for each group of centroids, a lower bound of the distance to the group's others.
In a round the distance to its own centroid is computed; groups that are provably farther,
beyond rounding and ties, are left out.  So every round gives the same clusters as a full search.

The state is a stage table made at some round and holds for all later ones, as only the straight
way of each centroid since then counts.  When too few products are saved, it is made anew.
Each round is one job: bounds, products and vector sums in the tasks, one small shuffle, and
the ``k`` means go to the driver, which sends centroids in any case.

Cosine search compares inner products only, also with a zero centroid.  Here that is a distance
as well: each centroid gets a coordinate that makes it a unit vector, in which vectors have 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.operators.assign import TIE
from vecprune.operators.kernels import to_lists, to_matrix, unit_rows
from vecprune.staging import drop_stage, stage_table

# Centroids that share a bound.
GROUP = 10
# The state is made anew if a round needed more than this share of all products.
REFRESH = 0.2


class Round(NamedTuple):
    """What a round of training did: all (vector, centroid) products, and those made."""

    number: int
    products: int
    made: int


class Centroids:
    """Centroids in groups, with what a search needs of them."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, spherical: bool, groups: list[np.ndarray]) -> None:
        self.ids, self.matrix, self.spherical, self.groups = ids, matrix, spherical, groups
        norms = np.einsum("ij,ij->i", matrix, matrix)
        # Nearest by the largest closeness; the squared distance is 2 (size - closeness).
        self.half_norms = np.zeros(len(ids)) if spherical else 0.5 * norms
        self.largest = 1.0 if spherical else float(norms.max())
        self.lift = np.sqrt(np.maximum(1.0 - norms, 0.0)) if spherical else np.zeros(len(ids))

    def moved(self, before: Centroids) -> np.ndarray:
        """How far each centroid is from where it was."""
        gap = self.matrix - before.matrix
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.lift - before.lift) ** 2)


def grouped(matrix: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """Numbers of the centroids in groups of about ``size``, near ones together.

    Some of the centroids are taken as middles and the others join the nearest; which group a
    centroid is in changes the work, not the result.
    """
    n = -(-len(matrix) // size)
    middles = matrix[np.linspace(0, len(matrix) - 1, n).astype(int)]
    for _ in range(3):
        norms = 0.5 * np.einsum("ij,ij->i", middles, middles)
        own = np.argmax(matrix @ middles.T - norms, axis=1)
        middles = np.array([matrix[own == g].mean(axis=0) if (own == g).any() else middles[g] for g in range(n)])
    return [np.flatnonzero(own == g) for g in range(n) if (own == g).any()]


def slack(x: np.ndarray, cents: Centroids) -> np.ndarray:
    """Twice the rounding error of a squared distance, and the tie."""
    size = np.einsum("ij,ij->i", x, x) + cents.largest
    return (x.shape[1] + 16) * 2.0**-49 * size + 4 * TIE


def search(
    x: np.ndarray, cents: Centroids, own: np.ndarray | None, bounds: np.ndarray | None, moved: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid, new bounds per group, and the number of products made.

    ``own`` and ``bounds`` are a state made before the centroids moved by ``moved``; without
    them everything is computed.  Among products within the tie the lowest number wins.
    """
    n, n_groups = len(x), len(cents.groups)
    error = slack(x, cents)
    size = np.ones(n) if cents.spherical else 0.5 * np.einsum("ij,ij->i", x, x)

    def least_distance(rows: np.ndarray, closeness: np.ndarray) -> np.ndarray:
        """Distances without what may be rounding."""
        side = (slice(None), *[None] * (closeness.ndim - 1))
        return np.sqrt(np.maximum(2.0 * (size[rows][side] - closeness) - error[rows][side], 0.0))

    every = np.arange(n)
    start = np.zeros(n, np.int64) if own is None else own.astype(np.int64)
    start_value = np.einsum("ij,ij->i", x, cents.matrix[start]) - cents.half_norms[start]
    if own is None:
        far = np.zeros((n, n_groups))
        near = np.ones((n, n_groups), bool)
    else:
        far = bounds - np.array([moved[g].max() for g in cents.groups])
        limit = np.maximum(2.0 * (size - start_value), 0.0) + 2.0 * error
        near = (far <= 0) | (far * far <= limit[:, None])
    pick, value, made = start.copy(), start_value.copy(), n
    closest = np.full((n, n_groups), -1)
    second = np.full((n, n_groups), np.inf)
    for g, members in enumerate(cents.groups):
        rows = np.flatnonzero(near[:, g])
        if len(rows) == 0:
            continue
        closeness = x[rows] @ cents.matrix[members].T - cents.half_norms[members]
        made += closeness.size
        top = closeness.max(axis=1)
        # The least number among the best of the group.
        best = members[np.argmax(closeness >= top[:, None] - TIE, axis=1)]
        gain = top - value[rows]
        better = (gain > TIE) | ((np.abs(gain) <= TIE) & (best < pick[rows]))
        pick[rows[better]], value[rows[better]] = best[better], top[better]
        at = closeness.argmax(axis=1)
        closest[rows, g] = members[at]
        far[rows, g] = least_distance(rows, top)
        if len(members) > 1:
            closeness[np.arange(len(rows)), at] = -np.inf
            second[rows, g] = least_distance(rows, closeness.max(axis=1))
    # A bound leaves out the row's own centroid, and holds for the one the row has left.
    far = np.where(near & (closest == pick[:, None]), second, far)
    group_of = np.empty(len(cents.ids), np.int64)
    for g, members in enumerate(cents.groups):
        group_of[members] = g
    left = every[(pick != start) & ~near[every, group_of[start]]]
    if len(left):
        g = group_of[start[left]]
        far[left, g] = np.minimum(far[left, g], least_distance(left, start_value[left]))
    return pick, far, made


def _rounded_down(bounds: np.ndarray) -> np.ndarray:
    return np.nextafter(bounds.astype(np.float32), np.float32(-np.inf))


def _vectors(column: pa.Array, spherical: bool) -> np.ndarray:
    x = to_matrix(column)
    return unit_rows(x) if spherical else x


STEP_CELLS = 4_000_000


def _steps(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    step = max(1, STEP_CELLS // k)
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def _no_zeros(batch: pa.RecordBatch, spherical: bool) -> pa.RecordBatch:
    """Without vectors that have no direction, for spherical clustering."""
    if not spherical or batch.num_rows == 0:
        return batch
    x = to_matrix(batch.column("vec"))
    some = np.einsum("ij,ij->i", x, x) > 0.0
    return batch if some.all() else batch.filter(pa.array(some))


def _new_state(sent, spherical: bool):
    """Kernel: vectors, with or without a state, to vectors with the state of these centroids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, moved = sent.value
        for batch in batches:
            old = "own" in batch.schema.names
            batch = batch if old else _no_zeros(batch, spherical)
            for part in _steps(batch, len(cents.ids)):
                x = _vectors(part.column("vec"), spherical)
                own = part.column("own").to_numpy() if old else None
                bounds = to_matrix32(part.column("bounds")) if old else None
                pick, far, _ = search(x, cents, own, bounds, moved)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec"), pa.array(pick.astype(np.int32)), to_lists32(_rounded_down(far))],
                    names=["vec", "own", "bounds"],
                )

    return kernel


def to_matrix32(column: pa.Array) -> np.ndarray:
    """Bounds as doubles; a group of one centroid, the row's own, has an infinite one."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def to_lists32(matrix: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def _sums(sent, spherical: bool):
    """Kernel: a state to vector sums per centroid, with the rows and the products of the task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, moved = sent.value
        total, n = np.zeros(cents.matrix.shape), np.zeros(len(cents.ids), np.int64)
        made = 0
        for batch in batches:
            for part in _steps(batch, len(cents.ids)):
                x = _vectors(part.column("vec"), spherical)
                own, bounds = part.column("own").to_numpy(), to_matrix32(part.column("bounds"))
                pick, _, products = search(x, cents, own, bounds, moved)
                made += products
                order = np.argsort(pick, kind="stable")
                groups, starts = np.unique(pick[order], return_index=True)
                total[groups] += np.add.reduceat(x[order], starts, axis=0)
                n += np.bincount(pick, minlength=len(n))
        there = np.flatnonzero(n)
        if len(there):
            # The products are told with the first centroid's row.
            products = np.zeros(len(there), np.int64)
            products[0] = made
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), to_lists(total[there]), pa.array(n[there]), pa.array(products)],
                names=["own", "sum", "n", "made"],
            )

    return kernel


def bounded_rounds(
    vectors: DataFrame,
    ids: np.ndarray,
    matrix: np.ndarray,
    niter: int,
    spherical: bool,
    report: Callable[[Round], None] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """``niter`` rounds from the centroids ``matrix``, numbered ``ids`` in ascending order.

    ``vectors`` has one column ``vec``; it is read once.  ``report`` is told what each round did.
    Returns the centroids and the numbers of those that no vector has joined in any round.
    """
    # Imported here, as the sums of lists need the ml package.
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    sc = vectors.sparkSession.sparkContext
    kind = vectors.schema["vec"].dataType.simpleString()
    groups = grouped(matrix)
    now = Centroids(ids, matrix, spherical, groups)
    state, made_at, share = None, now, 1.0
    joined = np.zeros(len(ids), bool)
    for number in range(niter):
        if share > REFRESH:
            moved = None if state is None else now.moved(made_at)
            sent = sc.broadcast((now, moved))
            source = vectors if state is None else state
            fresh = source.mapInArrow(_new_state(sent, spherical), f"vec {kind}, own int, bounds array<float>")
            before, state = state, stage_table(fresh, "kmeans-state")
            made_at = now
            if before is not None:
                drop_stage(before)
        sent = sc.broadcast((now, now.moved(made_at)))
        parts = state.mapInArrow(_sums(sent, spherical), "own int, sum array<double>, n long, made long")
        rows = parts.groupBy("own").agg(
            vector_to_array(Summarizer.sum(array_to_vector("sum"))).alias("sum"), F.sum("n"), F.sum("made")
        ).collect()
        matrix = now.matrix.copy()
        for own, total, n, _ in rows:
            joined[own] = True
            matrix[own] = np.array(total) if spherical else np.array(total) / n
        if spherical and rows:
            moved_rows = [r[0] for r in rows]
            matrix[moved_rows] = unit_rows(matrix[moved_rows])
        n_rows, made = sum(r[2] for r in rows), sum(r[3] for r in rows)
        share = made / max(1, n_rows * len(ids))
        if report is not None:
            report(Round(number + 1, n_rows * len(ids), made))
        now = Centroids(ids, matrix, spherical, groups)
        sent.unpersist()
    if state is not None:
        drop_stage(state)
    return now.matrix, np.flatnonzero(~joined)
