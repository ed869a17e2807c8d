"""Joins in which a NULL key is a key like any other."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, two NULLs being equal; the keys come once, from the left.

    The plan is left to AQE, as for an ordinary equality: broadcast if measured small, else a
    shuffle join whose hot keys are split.
    """
    names = {k: f"_same_{k}" for k in keys}
    others = [c for c in right.columns if c not in names]
    side = right.select(*[F.col(k).alias(name) for k, name in names.items()], *others)
    same = functools.reduce(
        lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(name)) for k, name in names.items())
    )
    return left.join(side, same, how).drop(*names.values())
