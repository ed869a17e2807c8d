"""Scans of the file layouts that hold embeddings, keys, clusters and datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecprune.operators.ordinal import ordinal
from vecprune.operators.validate import reject_reason
from vecprune.sources.raw import read_raw_keys, read_raw_matrix  # noqa: F401  (part of the readers)

# Column names that hold the image and the item id.
IMAGE_COLUMNS = ("image", "img", "pixel_values")
IMAGE_PARTS = ("image", "img")
ID_COLUMNS = ("index", "idx", "id")


def read_embeddings(
    spark: SparkSession,
    path: str,
    id_col: str = "item_id",
    vec_col: str = "embedding",
    dim: int | None = None,
) -> DataFrame:
    """Embedding table as ``(item_id, embedding)``.  With ``dim`` every vector is checked;
    use ``split_valid`` instead to set bad rows aside."""
    table = spark.read.parquet(path)
    table = table.select(
        F.col(id_col).cast("bigint").alias("item_id"), F.col(vec_col).alias("embedding")
    )
    if dim is not None:
        bad = table.where(reject_reason("embedding", dim).isNotNull()).count()
        if bad:
            raise ValueError(f"{bad} vectors in {path} are missing, not finite or not of length {dim}")
    return table


def spread_scan(table: DataFrame) -> DataFrame:
    """A freshly read table over all cores, for steps that cost far more CPU than reading,
    such as encoding.  Only a scan with fewer splits than there are cores is shuffled, so
    never one of a size that matters."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _split_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the splits, from the listing of the folder alone."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries if e.isDirectory()]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return sorted(unescape(n.split("=", 1)[1]) for n in names if n.startswith("split="))


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One split of a Parquet dataset partitioned by ``split``: the one asked for, else
    ``train``, else the first by name.  Only its files are read."""
    table = spark.read.parquet(path)
    if "split" not in table.columns:
        if split is not None:
            raise ValueError(f"{path} has no splits")
        return table
    names = _split_folders(spark, path)
    if not names:
        raise ValueError(f"{path} is not partitioned by split")
    if split is None:
        split = "train" if "train" in names else names[0]
    elif split not in names:
        raise ValueError(f"no split {split!r} in {path}, there are {names}")
    return table.where(F.col("split") == split)


def head_subset(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first ``n`` rows by ``order_col``."""
    return df.orderBy(order_col).limit(n)


def read_sorted_clusters(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """Sorted clusters in text form as ``(item_id, path, dist, cluster_id)``.

    ``sorted_cluster_{id}.txt`` files have 3 columns, or 2 without the path, and their
    cluster id comes from the file name; tables of ``write_sorted`` have it as 4th column.
    """
    item, key, dist = "item_id bigint", "path string", "dist double"
    schemas = {2: [item, dist], 3: [item, key, dist], 4: [item, key, dist, "cluster_id int"]}
    if columns not in schemas:
        raise ValueError("sorted clusters have 2, 3 or 4 columns")
    reader = spark.read.schema(", ".join(schemas[columns]))
    if columns == 4:
        # One folder per bucket below the path; the bucket itself is of no interest.
        rows = reader.option("recursiveFileLookup", True).csv(path, sep="\t", quote="")
        return rows.select("item_id", "path", "dist", "cluster_id")
    rows = reader.csv(path, sep="\t", quote="", pathGlobFilter="*cluster_*.txt")
    cluster_id = F.regexp_extract(F.col("_metadata.file_name"), r"cluster_([0-9]+)\.txt$", 1)
    if columns == 2:
        rows = rows.withColumn("path", F.lit(None).cast("string"))
    return rows.select("item_id", "path", "dist", cluster_id.cast("int").alias("cluster_id"))


def read_id_list(spark: SparkSession, path: str, numeric_only: bool = True) -> DataFrame:
    """One id per line, trimmed, blank lines dropped; ``(item_id BIGINT)``, or with
    ``numeric_only=False`` the texts as ``(id STRING)``.

    Lines that are no number, or none that fits a BIGINT, are not ids of items; read the texts
    to see them."""
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    lines = spark.read.text(path).select(text.alias("id")).where(F.col("id") != "")
    if not numeric_only:
        return lines
    numbers = lines.where(F.col("id").rlike("^[0-9]+$"))
    return numbers.select(F.col("id").try_cast("bigint").alias("item_id")).where("item_id IS NOT NULL")


def list_source_files(spark: SparkSession, folder: str, ext: str = ".jpg") -> DataFrame:
    """``(file_no, name, path)`` of the files with an extension, numbered from 0 by name.
    Only the listing is read, never the contents."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    named = files.select(F.substring_index("path", "/", -1).alias("name"), "path")
    return number_files(named.where(F.lower("name").endswith(ext.lower())))


def number_files(names: DataFrame) -> DataFrame:
    """Add ``file_no``, counted from 0 in the order of ``name``."""
    numbered = ordinal(names, [F.col("name").asc()], name="_no")
    others = [c for c in names.columns]
    return numbered.select((F.col("_no") - 1).alias("file_no"), *others)


def resolve_column(df: DataFrame, preferred: Sequence[str], contains: Sequence[str] = ()) -> str | None:
    """Name of the first preferred column there is, else of the first column whose name has
    one of the parts in ``contains`` in any case, else ``None``."""
    for name in preferred:
        if name in df.columns:
            return name
    for name in df.columns:
        if any(part.lower() in name.lower() for part in contains):
            return name
    return None


def image_column(df: DataFrame) -> str:
    """The column with the image."""
    name = resolve_column(df, IMAGE_COLUMNS, IMAGE_PARTS)
    if name is None:
        raise ValueError(f"no image column among {df.columns}")
    return name


def with_item_id(df: DataFrame) -> DataFrame:
    """``item_id`` from the column ``index``, ``idx`` or ``id``, else the row number."""
    name = resolve_column(df, ID_COLUMNS)
    if name is not None:
        return df.withColumn("item_id", F.col(name).cast("bigint"))
    indexed = df.withColumn("_scan_order", F.monotonically_increasing_id())
    return ordinal(indexed, [F.col("_scan_order").asc()], name="_no").select(
        *df.columns, (F.col("_no") - 1).alias("item_id")
    )
