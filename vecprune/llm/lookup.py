"""Joins with a table of unique keys of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most so many keys are broadcast: a key is hot if it holds more than this share of all rows.
HOT_KEYS = 4096


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on ``key``; ``n`` is the key's number of rows.

    Rows of hot keys meet a broadcast of at most ``HOT_KEYS`` rows and are not shuffled; all
    other keys are shuffled, and none of them holds more than a small share.  Both inputs
    should be stage tables, as they are read twice if there is a hot key.
    """
    sums = table.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    least = max((sums["all"] or 0) // HOT_KEYS, 64) + 1
    if (sums["most"] or 0) < least:
        return rows.join(table.drop(n), key, "left")
    hot = table.filter(F.col(n) >= least).drop(n)
    cold = table.filter(F.col(n) < least).drop(n)
    found = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return found.unionByName(others)
