"""Products of all pairs of a group that fits no task, tile by tile.

A tile is a few neighbouring blocks of rows, which a task holds, and a stretch of blocks that
stream past them.  So a vector is sent once per tile that needs it, not once per pair of blocks,
and a task's memory is that of the held blocks whatever the group's size.  A tile returns at most
one value of each kind per row it was given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecprune.operators.kernels import STRIPE, to_matrix, unit_rows

# Rows that a task holds, and rows that stream past them, in whole blocks: the smaller the
# blocks, the more of them go together, so that the copies of a row don't grow in number.
HELD_ROWS, STREAMED_ROWS = 1 << 14, 1 << 17
# At least so many blocks.
HELD, STREAMED = 2, 16
# Where only flags are wanted, a task holds a sixteenth of the largest group up to these bytes of
# vectors: up to there a row is sent to a number of tiles that does not grow with the group.
HELD_PARTS, HELD_BYTES = 16, 64 << 20
# Coordinates of a vector that bound its products, more of them that bound those of rows for which
# many are left, and streamed rows that are bounded at once.
LEADING, MORE, COLUMNS = 96, 256, 2048
# Rows that the axes of these coordinates are made from, and that are turned at once.
TURNED_ROWS = 8192
# Pairs that are bounded by more coordinates, or multiplied as a whole, in about the time that one
# pair picked out takes.
BOUNDED_PAIRS, DENSE_PAIRS = 256, 32
# Numbers of vectors picked out at once.
PICKED_CELLS = 1 << 22
# A cosine is near 1 or -1 by this much for rounding where its angle is taken.
ANGLE_MARGIN = 1e-3


def tile_blocks(block: int) -> tuple[int, int]:
    """How many blocks of so many rows a tile holds, and how many stream past them."""
    return max(HELD, HELD_ROWS // block), max(STREAMED, STREAMED_ROWS // block)


def held_for_flags(block: int, largest: int, vector_bytes: int) -> int:
    """How many blocks' rows a tile holds where only flags are wanted."""
    rows = max(HELD_ROWS, min(largest // HELD_PARTS, HELD_BYTES // max(1, vector_bytes)))
    return max(HELD, rows // block)


def ddl_of(df: DataFrame, names: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def tile_name(*parts: Column | str) -> Column:
    """A text that is different for different tiles, NULL parts included."""
    named = [(F.col(p) if isinstance(p, str) else p).alias(f"p{i}") for i, p in enumerate(parts)]
    return F.to_json(F.struct(*named))


def tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of rows of one ``_tile``; a tile may come in several."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tile = batch.column("_tile")
        changed = pc.not_equal(tile.slice(1), tile.slice(0, len(tile) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(changed) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield tile[a].as_py(), batch.slice(a, b - a)


class Held:
    """The held rows of a tile."""

    def __init__(self, normalize: bool) -> None:
        self.normalize, self.parts = normalize, []
        self.matrix = None

    def vectors(self, rows: pa.RecordBatch) -> np.ndarray:
        x = to_matrix(rows.column("_vec"))
        return unit_rows(x) if self.normalize else x

    def close(self) -> np.ndarray:
        """The vectors, once all held rows are there."""
        if self.matrix is None:
            self.table = pa.Table.from_batches(self.parts)
            self.matrix = np.concatenate([self.vectors(p) for p in self.parts])
            self.pos = self.table["_pos"].to_numpy()
        return self.matrix


def split_held(part: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    held = part.column("_held")
    return part.filter(held), part.filter(pc.invert(held))


def earlier_in_tiles(keep: list[str], normalize: bool):
    """Kernel: the largest product of each held row with a streamed row of lower ``_pos``."""

    def finish(rows: Held, best) -> Iterator[pa.RecordBatch]:
        if best is not None:
            found = rows.table.select(keep).append_column("_best", pa.array(best))
            yield from found.to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, best = None, Held(normalize), None
        for name, part in tile_runs(batches):
            if name != tile:
                yield from finish(rows, best)
                tile, rows, best = name, Held(normalize), None
            held, streamed = split_held(part)
            if held.num_rows:
                rows.parts.append(held)
            if not streamed.num_rows or not rows.parts:
                continue
            x = rows.close()
            best = np.zeros(len(x)) if best is None else best
            y, pos = rows.vectors(streamed), streamed.column("_pos").to_numpy()
            before = pos.max() < rows.pos.min()
            for lo in range(0, len(x), STRIPE):
                sims = x[lo : lo + STRIPE] @ y.T
                if not before:
                    sims[pos[None, :] >= rows.pos[lo : lo + STRIPE, None]] = 0.0
                best[lo : lo + STRIPE] = np.maximum(best[lo : lo + STRIPE], sims.max(axis=1))
        yield from finish(rows, best)

    return kernel


def leading_axes(x: np.ndarray, number: int) -> np.ndarray:
    """Orthonormal axes as columns: the first along the sum of the rows, the others about where
    they vary most.  Which axes are taken changes the work, not the result."""
    number = min(number, x.shape[1])
    axes = np.random.default_rng(0).normal(size=(x.shape[1], number))
    for _ in range(2):
        axes, _ = np.linalg.qr(np.column_stack([x.sum(axis=0), x.T @ (x @ axes[:, 1:])]))
    return axes


def leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of unit rows along the axes, and the length of what is left, in single precision.

    By Cauchy and Schwarz the product of two such rows is at least that of the vectors.
    """
    out = np.empty((len(x), axes.shape[1] + 1), np.float32)
    for lo in range(0, len(x), TURNED_ROWS):
        some = x[lo : lo + TURNED_ROWS]
        turned = some @ axes
        left = np.einsum("ij,ij->i", some, some) - np.einsum("ij,ij->i", turned, turned)
        out[lo : lo + TURNED_ROWS, :-1] = turned
        out[lo : lo + TURNED_ROWS, -1] = np.sqrt(np.maximum(left, 0.0) + 1e-12)
    return out


def _angles(rows: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows[:, 0].astype(np.float64), -1.0, 1.0))


class Flagged:
    """The held rows of a tile, of which only is asked which levels their largest earlier product is above.

    A row is open for the lowest level that it is not known to be above.  Its product with a streamed
    row is made only if the angles to the first axis and the leading coordinates leave it
    possible that it is above that level, beyond rounding.  Rows above all levels are left out.
    """

    def __init__(self, levels: list[float]) -> None:
        self.levels = np.array([*sorted(levels), np.inf])
        self.tables, self.parts = [], []
        self.axes = None

    def add(self, rows: pa.RecordBatch, keep: list[str]) -> None:
        column = rows.column("_vec")
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        self.parts.append(to_matrix(column).astype(kind))
        self.tables.append(pa.Table.from_batches([rows]).select(list(dict.fromkeys([*keep, "_pos", "_best"]))))

    def close(self) -> None:
        """Called once all held rows are there."""
        self.table = pa.concat_tables(self.tables)
        self.vectors = np.concatenate(self.parts)
        self.tables, self.parts = [], []
        self.pos, self.best = self.table["_pos"].to_numpy(), self.table["_best"].to_numpy().copy()
        self.axes = leading_axes(self.units(slice(None, None, -(-len(self.vectors) // TURNED_ROWS))), MORE)
        # What the rounding of a bound may hide, many times over.
        self.margin = (self.axes.shape[1] + 8) * 2.0**-22
        lead = self.turned(self.axes[:, :LEADING])
        # Rows of about the same angle go together.
        self.live = np.argsort(_angles(lead), kind="stable")
        self.lead, self.more = lead[self.live], None
        self.angle = _angles(self.lead)
        self.need = self.needed(self.live)

    def units(self, rows) -> np.ndarray:
        return unit_rows(self.vectors[rows].astype(np.float64))

    def turned(self, axes: np.ndarray) -> np.ndarray:
        starts = range(0, len(self.vectors), TURNED_ROWS)
        return np.concatenate([leading(self.units(slice(lo, lo + TURNED_ROWS)), axes) for lo in starts])

    def needed(self, rows: np.ndarray) -> np.ndarray:
        """What a bound must be above to matter; infinite for rows above all levels."""
        return self.levels[np.searchsorted(self.levels, self.best[rows], side="left")] - self.margin

    def meet(self, y: np.ndarray, pos: np.ndarray) -> None:
        """Compare with unit rows ``y``, of which those of lower ``pos`` count."""
        lead = leading(y, self.axes[:, :LEADING])
        angle = _angles(lead)
        order = np.argsort(angle, kind="stable")
        lead, angle, y, pos = lead[order], angle[order], y[order], pos[order]
        more, before = None, pos.max() < self.pos.min()
        for lo in range(0, len(self.live), STRIPE):
            some = slice(lo, lo + STRIPE)
            least = self.need[some].min()
            if least == np.inf:
                continue
            reach = np.arccos(np.clip(least, -1.0, 1.0)) + ANGLE_MARGIN
            a, b = np.searchsorted(angle, [self.angle[lo] - reach, self.angle[some][-1] + reach])
            for at in range(a, b, COLUMNS):
                end = min(at + COLUMNS, b)
                bounds = self.lead[some] @ lead[at:end].T
                near = np.flatnonzero(bounds.max(axis=1) > self.need[some])
                if len(near):
                    possible = bounds[near] > self.need[some][near, None]
                    if not before:
                        possible &= pos[None, at:end] < self.pos[self.live[lo + near]][:, None]
                    columns = np.flatnonzero(possible.any(axis=0))
                    possible = possible[:, columns]
                    if np.count_nonzero(possible) * BOUNDED_PAIRS > possible.size and LEADING < self.axes.shape[1]:
                        more = leading(y, self.axes) if more is None else more
                        possible &= self.bounded_closer(lo + near) @ more[at + columns].T > self.need[lo + near, None]
                    self.compare(lo + near, possible, y, at + columns)
        if np.count_nonzero(self.need == np.inf) * 4 > len(self.live):
            still = np.flatnonzero(self.need < np.inf)
            self.live, self.lead, self.angle, self.need = self.live[still], self.lead[still], self.angle[still], self.need[still]
            self.more = None if self.more is None else self.more[still]

    def bounded_closer(self, at: np.ndarray) -> np.ndarray:
        """More coordinates of held rows, made when they are first asked for."""
        if self.more is None:
            self.more = self.turned(self.axes)[self.live]
        return self.more[at]

    def compare(self, at: np.ndarray, possible: np.ndarray, y: np.ndarray, columns: np.ndarray) -> None:
        """The products of held rows with the streamed rows ``columns`` that are possible for them."""
        rows, number = self.live[at], np.count_nonzero(possible)
        if number == 0:
            return
        if number * DENSE_PAIRS < possible.size:
            i, j = np.nonzero(possible)
            there, i = np.unique(i, return_inverse=True)
            x, step = self.units(rows[there]), max(1, PICKED_CELLS // y.shape[1])
            for lo in range(0, number, step):
                some = slice(lo, lo + step)
                products = np.einsum("ij,ij->i", x[i[some]], y[columns[j[some]]])
                np.maximum.at(self.best, rows[there[i[some]]], products)
        else:
            sims = self.units(rows) @ y[columns].T
            sims[~possible] = 0.0
            self.best[rows] = np.maximum(self.best[rows], sims.max(axis=1))
        self.need[at] = self.needed(rows)


def flags_in_tiles(keep: list[str], levels: list[float]):
    """Kernel: for each held row a product with an earlier streamed row, or its ``_best`` so far, that
    is above the same ``levels`` as the largest of them."""

    def finish(rows: Flagged) -> Iterator[pa.RecordBatch]:
        if rows.axes is not None:
            found = rows.table.select(keep).append_column("_best", pa.array(rows.best))
            yield from found.to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, Flagged(levels)
        for name, part in tile_runs(batches):
            if name != tile:
                yield from finish(rows)
                tile, rows = name, Flagged(levels)
            held, streamed = split_held(part)
            if held.num_rows:
                rows.add(held, keep)
            if not streamed.num_rows or not (rows.parts or rows.axes is not None):
                continue
            if rows.axes is None:
                rows.close()
            if len(rows.live):
                rows.meet(unit_rows(to_matrix(streamed.column("_vec"))), streamed.column("_pos").to_numpy())
        yield from finish(rows)

    return kernel


def pair_values(x: np.ndarray, y: np.ndarray, x_pos: np.ndarray, y_pos: np.ndarray, diagonal: bool):
    """Largest, smallest and largest earlier product of each row of ``x`` and of ``y``, from 0 on.

    A row's product with itself (the same position) is 0.  Off the diagonal all of ``y`` comes
    after all of ``x``.
    """
    of_x, of_y = np.zeros((3, len(x))), np.zeros((3, len(y)))
    for lo in range(0, len(x), STRIPE):
        some = slice(lo, lo + STRIPE)
        sims = x[some] @ y.T
        if diagonal:
            sims[x_pos[some, None] == y_pos[None, :]] = 0.0
            after = y_pos[None, :] > x_pos[some, None]
            of_x[2, some] = np.maximum(np.where(after, 0.0, sims).max(axis=1), 0.0)
            of_y[2] = np.maximum(of_y[2], np.where(after, sims, 0.0).max(axis=0))
        else:
            of_y[2] = np.maximum(of_y[2], sims.max(axis=0))
        of_x[0, some], of_x[1, some] = np.maximum(sims.max(axis=1), 0.0), np.minimum(sims.min(axis=1), 0.0)
        of_y[0], of_y[1] = np.maximum(of_y[0], sims.max(axis=0)), np.minimum(of_y[1], sims.min(axis=0))
    return of_x, of_y


VALUES = ("_max", "_min", "_best")


def _with_values(rows: pa.Table, values: np.ndarray) -> pa.Table:
    for name, column in zip(VALUES, values):
        rows = rows.append_column(name, pa.array(column))
    return rows


def values_in_tiles(keep: list[str], normalize: bool):
    """Kernel: the values of ``pair_values`` for held and streamed rows, one row for each."""

    def finish(rows: Held, values) -> Iterator[pa.RecordBatch]:
        if values is not None:
            yield from _with_values(rows.table.select(keep), values).to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, values = None, Held(normalize), None
        for name, part in tile_runs(batches):
            if name != tile:
                yield from finish(rows, values)
                tile, rows, values = name, Held(normalize), None
            held, streamed = split_held(part)
            if held.num_rows:
                rows.parts.append(held)
            if not streamed.num_rows:
                continue
            x = rows.close()
            values = np.zeros((3, len(x))) if values is None else values
            same = streamed.column("_diagonal")
            for diagonal, some in ((True, streamed.filter(same)), (False, streamed.filter(pc.invert(same)))):
                if not some.num_rows:
                    continue
                y = rows.vectors(some)
                of_x, of_y = pair_values(x, y, rows.pos, some.column("_pos").to_numpy(), diagonal)
                values = np.stack(
                    [np.maximum(values[0], of_x[0]), np.minimum(values[1], of_x[1]), np.maximum(values[2], of_x[2])]
                )
                found = _with_values(pa.Table.from_batches([some]).select(keep), of_y)
                yield from found.to_batches()
        yield from finish(rows, values)

    return kernel


def _inside(keep: list[str], normalize: bool):
    def run(table: pa.Table) -> pa.Table:
        x = to_matrix(table["_vec"])
        x = unit_rows(x) if normalize else x
        pos = table["_pos"].to_numpy()
        values, _ = pair_values(x, x, pos, pos, True)
        return _with_values(table.select(keep), values)

    return run


def pair_stats(
    rows: DataFrame,
    keys: list[str],
    id_col: str,
    largest: int,
    block: int,
    normalize: bool = True,
    held: int | None = None,
    streamed: int | None = None,
) -> DataFrame:
    """``(keys, id, _max, _min, _best)``: largest, smallest and largest earlier product of each
    row with the others of its group, from one pass over all pairs; 0 counts for each.

    ``rows`` has ``_pos``, different within a group, ``_blk``, which must not fall with ``_pos``
    if ``_best`` is wanted, ``_nb``, the group's number of blocks, and ``_vec``.  It should be
    a stage table.
    """
    keep = [*keys, id_col]
    ddl = f"{ddl_of(rows, keep)}, _max double, _min double, _best double"
    if largest <= block:
        return rows.groupBy(*keys).applyInArrow(_inside(keep, normalize), ddl)
    usual = tile_blocks(block)
    held, streamed = held or usual[0], streamed or usual[1]
    group = F.expr(f"_blk div {held}")
    stretch = F.expr(f"_blk div {streamed}")
    columns = [*keep, "_pos", "_vec"]
    # Held blocks meet themselves and all later ones, stretch by stretch.
    stretches = F.sequence(F.expr(f"(_blk div {held}) * {held} div {streamed}"), F.expr(f"(_nb - 1) div {streamed}"))
    as_held = rows.withColumn("_stretch", F.explode(stretches)).select(
        *columns, F.lit(True).alias("_held"), F.lit(False).alias("_diagonal"),
        tile_name(*keys, group, "_stretch").alias("_tile"),
    )
    as_streamed = rows.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), group))).select(
        *columns, F.lit(False).alias("_held"), (F.col("_group") == group).alias("_diagonal"),
        tile_name(*keys, "_group", stretch).alias("_tile"),
    )
    dealt = as_held.unionByName(as_streamed).repartition("_tile").sortWithinPartitions("_tile", F.desc("_held"))
    found = dealt.mapInArrow(values_in_tiles(keep, normalize), ddl)
    return found.groupBy(*keep).agg(
        F.max("_max").alias("_max"), F.min("_min").alias("_min"), F.max("_best").alias("_best")
    )
