"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits, eight positional bytes.  Fingerprints that differ in at
most three bits share at least five of the eight bytes: that is the guaranteed count.  Lists
for single bytes would hold a 256th of all fingerprints each and their pairs would be
quadratic, so the index holds lists for three bytes of one half (first or last four): of five
shared bytes at least three fall in one half, so each linked pair meets in one of eight lists
of 24 bits.  Pairs that meet are tallied by their shared positional bytes, those below five go,
and the rest is verified by counting bits.

Equal fingerprints are one node.  A list is searched outwards from one fingerprint over those
not yet reached, so a dense group costs far less than its pairs, and gives the links of a
spanning forest only, never all pairs.  A list of more than ``BLOCK`` fingerprints is cut in
parts, and each two parts are one group, so no task holds a whole hot list.

Defined results: a NULL or empty text, or one without words, has fingerprint zero and is linked
like any other; rows with equal ids are separate rows that share their id; a component's id is
its smallest id that is not NULL; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecprune.llm.components import components
from vecprune.llm.grouped import group_batches
from vecprune.llm.text import add_columns, chunks
from vecprune.session import ship_package
from vecprune.staging import stage_table

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
BLOCK = 4096
_SLICE = 1 << 18


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every word shingle; fewer words than ``size`` are one shingle."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(column: pa.Array, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A bit is set if it is set in more than half of the hashes."""
    texts = column.cast(pa.binary()).to_pylist()
    hashes: list[int] = []
    counts = []
    for text in texts:
        new = shingle_hashes(text, size) if text else []
        counts.append(len(new))
        hashes += new
    flat, owner = np.array(hashes, np.uint64), np.repeat(np.arange(len(texts)), counts)
    ones = np.zeros((len(texts), 64), np.int64)
    for at in range(0, len(flat), _SLICE):
        part = flat[at : at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        mine = owner[at : at + _SLICE]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        sums = np.add.reduceat(np.unpackbits(part, axis=1), first, axis=0, dtype=np.int64)
        ones[mine[first]] += sums
    bits = 2 * ones > np.array(counts).reshape(-1, 1)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def search_list(prints: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least node of each linked group of a list to its other nodes."""
    order = np.argsort(nodes)
    open_ = order
    roots, members = [], []
    while len(open_) > 1:
        root, open_ = open_[0], open_[1:]
        front = [root]
        while front and len(open_):
            diff = prints[open_] ^ prints[front.pop()]
            shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = np.flatnonzero(shared >= MIN_SHARED)
            near = near[np.bitwise_count(diff[near]) <= MAX_BITS]
            if len(near):
                found = open_[near]
                front.extend(found)
                roots.append(np.full(len(found), nodes[root]))
                members.append(nodes[found])
                open_ = np.delete(open_, near)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(roots), np.concatenate(members)) if roots else (empty, empty)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in group_batches(batches, ["list", "low", "high"]):
        prints = table.column("print").to_numpy().view(np.uint64)
        nodes = table.column("node").to_numpy()
        a, b = [], []
        for x, y in zip(starts, [*starts[1:], table.num_rows]):
            roots, members = search_list(prints[x:y], nodes[x:y])
            a.append(roots)
            b.append(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]
        )


def _lists(value: Column) -> Column:
    """The eight lists of a fingerprint: a half, a byte left out, and the other three."""
    byte = [F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for half in (0, 4):
        for left_out in range(4):
            key = F.lit(half + left_out).cast("long")
            for i in range(4):
                if i != left_out:
                    key = key * 256 + byte[half + i]
            keys.append(key)
    return F.array(*keys)


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between nodes ``(print, node)`` that connect all within three bits."""
    posted = prints.select("print", "node", F.explode(_lists(F.col("print"))).alias("list"))
    long = posted.groupBy("list").count().filter("count > 1")
    parts = F.ceil(F.col("count") / block)
    pairs = (
        posted.join(long, "list")
        .select("list", "print", "node", parts.alias("parts"), F.pmod(F.col("node"), parts).alias("part"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(
            "list", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
            "print", "node",
        )
    )
    keys = ["list", "low", "high"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search, "a long, b long")


def _printed(docs: DataFrame, columns: list[str], text_col: str, size: int, name: str) -> DataFrame:
    """The columns and the fingerprint as a long column."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                values = fingerprints(part.column(text_col), size).view(np.int64)
                yield add_columns(part, columns, **{name: values})

    schema = docs.select(*columns).schema.add(name, "long")
    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(kernel, schema)


def _labelled(firsts: DataFrame) -> DataFrame:
    """``(print, first)`` with ``node`` and the ``label`` of its component."""
    nodes = stage_table(firsts.withColumn("node", F.xxhash64("print")), "nodes")
    labels = stage_table(components(near_links(nodes)), "labels")
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS
) -> DataFrame:
    """One row per document: id, ``print`` (long) and ``component_id``."""
    marked = stage_table(_printed(docs, [id_col], text_col, size, "print"), "prints")
    grown = _labelled(marked.groupBy("print").agg(F.min(id_col).alias("first")))
    first = grown.groupBy("label").agg(F.min("first").alias("component_id"))
    named = grown.join(first, "label").select("print", "component_id")
    return marked.join(named, "print").select(id_col, "print", "component_id")


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (NULL last); all columns stay.

    Of rows that share this id one stays.  Columns may have any names.
    """
    print_col, row_col = free_name(docs.columns, "print"), free_name(docs.columns, "row")
    rows = _printed(docs, docs.columns, text_col, SHINGLE_WORDS, print_col)
    rows = stage_table(rows.withColumn(row_col, F.monotonically_increasing_id()), "printed")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))
    grown = _labelled(rows.groupBy(F.col(print_col).alias("print")).agg(F.min(order).alias("first")))
    kept = grown.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row_col))
    return rows.join(kept, row_col, "left_semi").select(*docs.columns)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
