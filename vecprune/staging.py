"""Stage tables: intermediate results written once to the cluster's shared folder.

A stage table cuts lineage and survives lost executors.  Parquet rather than RDD
checkpoint files, so that later narrow reads skip the vectors.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_scopes: list[list[str]] = []


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: the session's ``spark.checkpoint.dir``.

    Only a local session, where the driver's disk is every task's disk, falls back to a
    temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="vecprune-")
    return _local_roots[sc.applicationId]


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path for a stage table of this application."""
    folder = f"vecprune-stages/{spark.sparkContext.applicationId}"
    path = f"{stage_root(spark)}/{folder}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Drops at its end the stage tables made within it.

    Results are read from stage tables, so the scope has to hold the writing of the result too::

        with stage_scope(spark):
            kept, rejects = dedup(documents, options)
            kept.write.parquet(out)
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this application, once its results are written."""
    _delete(spark, stage_path(spark, "x").rsplit("/", 1)[0])


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the stage root and return it as a scan."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def drop_stage(df: DataFrame) -> None:
    """Delete a table that ``stage_table`` returned, once nothing reads it any more."""
    _delete(df.sparkSession, df.stage_path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` holds a finished Spark output (its commit marker is there)."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


SIDE = ".unfinished-"


def save_table(df: DataFrame, path: str) -> None:
    """Write ``df`` so that ``path`` is there as a whole or not at all.

    The rows go to a folder beside it, which gets the name when it is finished.  What died runs
    have left, beside ``path`` or without a commit marker in its place, is deleted; so no two
    runs should save to one path at a time.  If another one has finished, its table stays.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    parent = target.getParent()
    if files.exists(parent):
        for entry in files.listStatus(parent):
            if entry.getPath().getName().startswith(target.getName() + SIDE):
                files.delete(entry.getPath(), True)
    side = f"{path.rstrip('/')}{SIDE}{uuid.uuid4().hex}"
    df.write.parquet(side)
    if table_exists(spark, path):
        _delete(spark, side)
        return
    files.delete(target, True)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(side), target):
        raise OSError(f"{side} could not be renamed to {path}")


def load_or_save(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table saved at ``path``; made and saved there if there is none that is finished."""
    if not table_exists(spark, path):
        save_table(make(), path)
    return spark.read.parquet(path)
