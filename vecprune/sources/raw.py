"""Headerless files of fixed-width records as a data source of Spark.

The driver looks at file sizes only.  A partition is a byte range of whole records; a task reads
it in pieces straight into Arrow batches, and a record's number is its offset over the width, so
nothing is counted and no record is an object.  A folder is read like one file: its files follow
each other by name.

Paths are opened with Arrow's file systems (local or shared folders, ``s3://``, ``gs://``,
``hdfs://`` and what else they know).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vecprune.functions.names import STORED_KEY_WIDTH, decode_key
from vecprune.operators.kernels import to_matrix
from vecprune.session import ship_package

# Bytes of a partition and of a batch, about.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SOURCE = "fixed_width"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is a local or shared folder."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(path)


@dataclass
class RecordRange(InputPartition):
    path: str
    offset: int
    first: int
    records: int


class FixedWidthReader(DataSourceReader):
    def __init__(self, path: str, width: int, dim: int, size: int = PARTITION_BYTES) -> None:
        self.path, self.width, self.dim, self.size = path, width, dim, size

    def files(self) -> list[tuple[str, int]]:
        """Path and size of each file, in order of the names; hidden ones are left out."""
        system, path = open_path(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"there is no {self.path}")
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        inside = system.get_file_info(fs.FileSelector(path))
        found = [f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        return [(f.path, f.size) for f in sorted(found, key=lambda f: f.base_name)]

    def partitions(self) -> list[RecordRange]:
        step = max(1, self.size // self.width)
        out, first = [], 0
        for path, size in self.files():
            if size % self.width:
                raise ValueError(f"{path} has {size} bytes, which is no multiple of a record's {self.width}")
            n = size // self.width
            for at in range(0, n, step):
                out.append(RecordRange(path, at * self.width, first + at, min(step, n - at)))
            first += n
        return out

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without any record
            return
        system, _ = open_path(self.path)
        step = max(1, BATCH_BYTES // self.width)
        with system.open_input_file(partition.path) as file:
            for at in range(0, partition.records, step):
                n = min(step, partition.records - at)
                raw = file.read_at(n * self.width, partition.offset + at * self.width)
                if len(raw) < n * self.width:
                    raise ValueError(f"{partition.path} has become shorter")
                ids = np.arange(partition.first + at, partition.first + at + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), self.values(raw, n)], names=["item_id", "value"])

    def values(self, raw: bytes, n: int) -> pa.Array:
        if self.dim:
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.dim)
            return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(raw, "<f4")))
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.width), n, [None, pa.py_buffer(raw)])
        return fixed.cast(pa.binary())


class FixedWidthSource(DataSource):
    """Options: ``path``, ``width`` in bytes, ``dim`` if a record is a vector of floats, and
    ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        value = "array<float>" if int(self.options.get("dim", 0)) else "binary"
        return f"item_id bigint, value {value}"

    def reader(self, schema) -> FixedWidthReader:
        size = int(self.options.get("partitionbytes", PARTITION_BYTES))
        return FixedWidthReader(self.options["path"], int(self.options["width"]), int(self.options.get("dim", 0)), size)


def _records(spark: SparkSession, path: str, width: int, dim: int, size: int) -> DataFrame:
    if width < 1:
        raise ValueError("a record must have at least one byte")
    ship_package(spark)
    spark.dataSource.register(FixedWidthSource)
    return spark.read.format(SOURCE).options(path=path, width=width, dim=dim, partitionBytes=size).load()


def read_raw_matrix(spark: SparkSession, path: str, dim: int, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Headerless row-major float32 file, or folder of such files, as ``(item_id, embedding)``;
    the id is the row number.  A file with a part of a row is an error."""
    return _records(spark, path, 4 * dim, dim, partition_bytes).withColumnRenamed("value", "embedding")


def read_raw_keys(
    spark: SparkSession, path: str, width: int = STORED_KEY_WIDTH, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """Headerless file, or folder of files, of fixed-width, NUL-padded keys as ``(item_id, path)``."""
    return _records(spark, path, width, 0, partition_bytes).select("item_id", decode_key("value").alias("path"))


def write_raw(df: DataFrame, path: str, order_col: str, value_col: str, width: int = 0) -> int:
    """Vectors, or keys of ``width`` bytes, as raw files in the order of ``order_col``; returns
    their number of records.

    Every task writes one file and gives it its name when it is whole, so a task that is run
    again leaves no trace.  Shorter keys are padded, longer ones are an error.
    """
    ship_package(df.sparkSession)
    system, folder = open_path(path)
    system.create_dir(folder, recursive=True)

    def encode(values: pa.Array) -> bytes:
        if not width:
            return np.ascontiguousarray(to_matrix(values), "<f4").tobytes()
        keys = values.cast(pa.binary()).to_pylist()
        if any(k is None or len(k) > width for k in keys):
            raise ValueError(f"a key is missing or longer than {width} bytes")
        return b"".join(k.ljust(width, b"\0") for k in keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_path(path)
        part = TaskContext.get().partitionId()
        side, n = f"{folder}/.{uuid.uuid4().hex}", 0
        with system.open_output_stream(side) as out:
            for batch in batches:
                if batch.num_rows:
                    out.write(encode(batch.column(0)))
                    n += batch.num_rows
        system.move(side, f"{folder}/part-{part:06d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = df.select(F.col(order_col).alias("_order"), F.col(value_col).alias("_value"))
    ordered = rows.repartitionByRange("_order").sortWithinPartitions("_order")
    return ordered.select("_value").mapInArrow(kernel, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
