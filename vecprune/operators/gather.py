"""Joins between items, vectors, keys, payload and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.functions.names import base_name, output_name, with_default_ext
from vecprune.operators.joins import join_on_keys


def _checked(rows: DataFrame, found: str, what: str) -> DataFrame:
    """``rows`` without the marker ``found``; a row without it ends the job."""
    lost = F.raise_error(F.lit(what))
    marker = F.when(F.col(found).isNull(), lost).otherwise(F.col(found))
    # The marker is part of the filter, so that it is evaluated for every row.
    return rows.where(marker).drop(found)


def attach_embeddings(clusters: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Cluster members with their vectors, joined on the item id.

    A member without a vector is an error; ``missing_ids`` lists such members.
    """
    vectors = embeddings.select("item_id", "embedding", F.lit(True).alias("_found"))
    rows = clusters.join(vectors, "item_id", "left")
    return _checked(rows, "_found", "a cluster member has no vector")


def attach_keys(pruned: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pruning table with the keys of the ranked clusters.  Joined on the ids, so the order
    of either table does not matter; an item without a row in ``ranked`` is an error."""
    keys = ranked.select("cluster_id", "item_id", "path", F.lit(True).alias("_found"))
    rows = join_on_keys(pruned, keys, ["cluster_id", "item_id"], "left")
    return _checked(rows, "_found", "an item of the pruning table has no key")


def keep_items(
    dataset: DataFrame,
    kept: DataFrame,
    *,
    id_col: str = "item_id",
    label_col: str | None = None,
    path_col: str | None = "image_path",
) -> DataFrame:
    """The dataset rows whose id is in ``kept``, with all columns, plus the output name."""
    rows = dataset.join(kept.select(id_col), id_col, "left_semi")
    return rows if path_col is None else rows.withColumn(path_col, output_name(id_col, label_col))


def missing_ids(ids: DataFrame, dataset: DataFrame, *, id_col: str = "item_id") -> DataFrame:
    """Wanted ids that the dataset does not have."""
    return ids.join(dataset.select(id_col), id_col, "left_anti")


def resolve_files(
    ids: DataFrame,
    files: DataFrame,
    *,
    pattern: str | None = None,
    ext: str = ".jpg",
    id_col: str = "id",
) -> DataFrame:
    """Source file and target name of each wanted id (text).

    A number within range means the file of that ``file_no``; beyond the range the
    ``pattern`` names it, if there is one.  Any other text is a name, completed with the
    default extension.  ``files`` has ``file_no`` and ``name``.  ``status`` is ``found`` or
    ``missing``.
    """
    wanted = F.col(id_col)
    is_number = wanted.rlike("^[0-9]+$")
    # 18 digits fit a BIGINT; longer numbers are beyond any file count.
    number = F.when(is_number & (F.length(wanted) <= 18), wanted).cast("bigint")
    # Names get numbers that no file has, all different, rather than one common NULL: they
    # would meet in a single task.
    spread = -1 - F.pmod(F.xxhash64(wanted), F.lit(1 << 40))
    by_number = ids.withColumn("_no", F.coalesce(number, spread)).join(
        files.select(F.col("file_no").alias("_no"), F.col("name").alias("_numbered")), "_no", "left"
    )
    named = F.when(~is_number, with_default_ext(wanted, ext))
    if pattern is not None:
        named = F.when(is_number, output_name(wanted, pattern=pattern)).otherwise(named)
    candidate = F.coalesce("_numbered", named)
    # Once each: folders may hold files of the same name.
    names = files.select(F.col("name").alias("source_file")).distinct().withColumn("_exists", F.lit(True))
    checked = by_number.withColumn("source_file", candidate).join(names, "source_file", "left")
    found = F.col("_exists").isNotNull()
    target = F.when(is_number, F.col("source_file")).otherwise(base_name("source_file"))
    return checked.select(
        *ids.columns,
        "source_file",
        F.when(found, target).alias("target_file"),
        F.when(found, "found").otherwise("missing").alias("status"),
    )
