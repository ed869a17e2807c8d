"""Plan of a download: what to fetch under which name.  Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.functions.names import normalize_ext


def fetch_manifest(
    df: DataFrame,
    existing: DataFrame,
    *,
    id_col: str = "item_id",
    url_col: str = "url",
    ext_col: str | None = None,
) -> DataFrame:
    """``(id, url, name, status)``: ``skipped`` if a file of that name exists already,
    ``invalid`` without a url, else ``fetch``.  ``existing`` has the column ``name``."""
    ext = normalize_ext(ext_col if ext_col else F.lit(None).cast("string"))
    url = F.col(url_col)
    named = df.select(
        id_col,
        url.alias("url"),
        F.concat(F.lit("image_"), F.col(id_col).cast("string"), F.lit("."), ext).alias("name"),
    )
    present = existing.select("name", F.lit(True).alias("_present")).distinct()
    no_url = F.col("url").isNull() | (F.trim("url") == "")
    status = (
        F.when(no_url, "invalid").when(F.col("_present"), "skipped").otherwise("fetch")
    )
    return named.join(present, "name", "left").select(id_col, "url", "name", status.alias("status"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """Rows per status."""
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
