"""Vector sums per group, added up inside the tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.operators.kernels import to_lists, to_matrix, unit_rows

# Sums a task keeps before it hands them on.
HELD_BYTES = 64 << 20


def _partial_sums(keys: list[str], normalize: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None

        def hand_on() -> pa.RecordBatch:
            columns = [
                pa.array([k[i] for k in held], schema.field(name).type)
                for i, name in enumerate(keys)
            ]
            sums = to_lists(np.array([v[0] for v in held.values()]))
            counts = pa.array([v[1] for v in held.values()], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, sums, counts], [*keys, "_sum", "_n"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = batch.schema
            x = to_matrix(batch.column(len(keys)))
            if normalize:
                x = unit_rows(x)
            codes = []
            for i in range(len(keys)):
                column = batch.column(i)
                codes += [pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)]
            groups, inverse = np.unique(np.stack(codes, axis=1), axis=0, return_inverse=True)
            inverse = inverse.ravel()
            order = np.argsort(inverse, kind="stable")
            starts = np.searchsorted(inverse[order], np.arange(len(groups)))
            sums = np.add.reduceat(x[order], starts, axis=0)
            counts = np.bincount(inverse)
            named = [
                tuple(None if g[i + 1] else g[i] for i in range(0, len(g), 2)) for g in groups.tolist()
            ]
            for key, total, n in zip(named, sums, counts.tolist()):
                entry = held.get(key)
                if entry is None:
                    held[key] = [total.copy(), n]
                else:
                    entry[0] += total
                    entry[1] += n
            if len(held) * x.shape[1] * 8 > HELD_BYTES:
                yield hand_on()
        if held:
            yield hand_on()

    return run


def vector_sums(
    df: DataFrame, keys: Sequence[str], vec_col: str = "embedding", normalize: bool = True
) -> DataFrame:
    """``(keys, _sum, _n)``: sum of the (normalized) vectors and row count of each group of
    whole-number ``keys``."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _sum array<double>, _n bigint"
    partial = df.select(*keys, vec_col).mapInArrow(_partial_sums(keys, normalize), ddl)
    return partial.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector("_sum"))).alias("_sum"),
        F.sum("_n").alias("_n"),
    )
