"""A seeded hash of an id that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, item_id: Column | str) -> Column:
    """60-bit number from the md5 of ``seed:id``; depends on nothing but its arguments, so
    shuffles and splits made with it do not change with the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col(item_id) if isinstance(item_id, str) else item_id))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
