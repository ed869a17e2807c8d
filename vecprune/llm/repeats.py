"""Windows that occur more than once anywhere in a corpus, without bringing it together.

The method that finds repeats works on text in memory; this module deals the text out, so that
equal windows meet in one task.  It works on symbols (bytes or words) and windows of a fixed
number of them.

* A window is owned by its smallest gram (a hash of a few symbols).  Equal windows have equal
  owners.  Neighbouring windows mostly share theirs, so a document is cut in slices: runs of at
  most ``LONGEST`` window starts with one owner, and the text of these windows.  Long texts are
  cut segment by segment, in bounded memory.
* Equal slices are found by grouping; every window in them is a repeat.  Copies of documents
  and passages end here, as numbers that are aggregated before the shuffle.
* Owners with several different slices are left, and slices whose owner stands in them more
  than once: a text that repeats a few symbols has equal windows within one.  One example of each such slice is fetched
  from its document and dealt out by owner, and a kernel searches the slices of an owner for
  equal windows.
* An owner with more than ``HOT`` different slices is not brought into one task: its windows
  are grouped by a 128-bit hash, counted in the tasks first.

What is found goes back to the documents as spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.llm.grouped import group_batches
from vecprune.llm.text import chunks, mix, prefix_hash, span_hash
from vecprune.session import ship_package
from vecprune.staging import stage_table

HOT = 8192
BUNDLE_BYTES = 320 << 10
LONGEST = 512
_PLACE_BITS = 26
# Bytes of a text that are cut at once; the arrays for them take about a hundred times as many.
SEGMENT = 1 << 21


@dataclass(frozen=True)
class Kind:
    """What the windows are made of."""

    window: int
    gram: int
    # Bytes that a symbol has, about.
    width: int
    # Of a text column: the prefix hashes of all symbols and the offsets of the texts in them.
    symbols: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    # Of a long text, a size and a window: pieces as (bytes, symbols before them, window starts in them).
    segments: Callable[[bytes, int, int], Iterator[tuple[bytes, int, int]]]
    # Of a text: a function that gives the content of symbols ``a`` to ``b``.
    cutter: Callable[[str], Callable[[int, int], bytes]]
    # Of contents: their symbols as numbers, one after the other, and the number in each.
    numbers: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    # Of numbers and window starts in order of their documents: (is a repeat, has an earlier one).
    search: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys, from minima within blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    so_far = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], so_far[width - 1 : n])


def slices(prefix: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of window starts with one owner: text, first start, number, owner and content hash."""
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    texts = np.flatnonzero(count)
    if not len(texts):
        empty = np.zeros(0, np.int64)
        return dict(text=empty, start=empty, n=empty, owner=empty, content=empty, inner=np.zeros(0, bool))
    text = np.repeat(texts, count[texts])
    within = np.arange(len(text)) - np.repeat(np.cumsum(count[texts]) - count[texts], count[texts])
    start = offsets[text] + within
    low, high = start[0], start[-1] + window
    place = np.arange(low, high - gram + 1)
    grams = span_hash(prefix, place, place + gram)
    bits = np.uint64(_PLACE_BITS)
    last = np.uint64((1 << _PLACE_BITS) - 1)
    keys = (grams >> bits << bits) | (last - (place - low).astype(np.uint64))
    least = window_minimum(keys, window - gram + 1)[start - low]
    at = (last - (least & last)).astype(np.int64)
    owner = grams[at]
    # Equal grams own one run together, such as those of a text that repeats a few symbols.
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(start)))
    new[run.repeat(-(-size // LONGEST)) + LONGEST * _counted(-(-size // LONGEST))] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    begin = start[first]
    content = span_hash(prefix, begin, begin + n + window - 1)
    # Equal windows have their owner at the same offset, so within a slice it is at several places.
    inner = at[first] != at[first + n - 1]
    return dict(
        text=text[first], start=begin - offsets[text[first]], n=n,
        owner=owner[first].view(np.int64), content=content.view(np.int64), inner=inner,
    )


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def runs_of(flags: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each piece of the flags (of these sizes) its runs of True as (from, to)."""
    ends = np.cumsum(size)
    edge = np.zeros(len(flags) + 1, bool)
    edge[np.concatenate([[0], ends])] = True
    here = flags & (edge[:-1] | ~np.concatenate([[False], flags[:-1]])) if len(flags) else flags
    last = flags & (edge[1:] | ~np.concatenate([flags[1:], [False]])) if len(flags) else flags
    a, b = np.flatnonzero(here), np.flatnonzero(last) + 1
    piece = np.searchsorted(ends, a, side="right")
    begin = (ends - size)[piece]
    offsets = np.searchsorted(a, np.concatenate([[0], ends]))
    pairs = pa.StructArray.from_arrays(
        [pa.array((a - begin).astype(np.int32)), pa.array((b - begin).astype(np.int32))], names=["a", "b"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


RUNS = "array<struct<a:int,b:int>>"


def repeat_spans(docs: DataFrame, kind: Kind, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """``id, mark, spans`` of the documents ``(id, text, mark)`` that have repeats.

    ``spans`` are (from, to) in symbols; they may overlap.  With ``keep_first`` the first of
    equal windows, by id and place, is no repeat.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema["id"].dataType.simpleString()
    cut = stage_table(_cut(docs, kind, id_type), "slices")
    where = F.struct("id", "mark", "start", "n")
    each = stage_table(
        cut.groupBy("owner", "content").agg(
            F.count("*").alias("copies"), F.min(where).alias("first"), F.max("inner").alias("inner")
        ),
        "slice-counts",
    )
    # A slice that is alone may still hold equal windows, where a text repeats a few symbols.
    several = each.groupBy("owner").agg(F.count("*").alias("different"), F.max("inner").alias("inner"))
    several = several.filter("different > 1 OR inner").drop("inner")
    mixed = each.join(several, "owner").select("owner", "content", "different", "first.*")
    texts = stage_table(_fetch(docs, mixed, kind, id_type), "slice-texts")
    small = texts.filter(F.col("different") <= hot)
    found = _search_small(small, kind, keep_first).unionAll(
        _search_hot(texts.filter(F.col("different") > hot), kind, keep_first, id_type)
    )
    found = stage_table(found, "slice-repeats")

    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    known = each.filter("copies > 1").join(found, ["owner", "content"], "full_outer")
    known = known.select("owner", "content", F.coalesce("copies", F.lit(1)).alias("copies"), "first", "runs")
    back = cut.join(known, ["owner", "content"])
    if keep_first:
        later = (F.col("copies") > 1) & ~where.eqNullSafe(F.col("first"))
    else:
        later = F.col("copies") > 1
    runs = F.when(later, whole).otherwise(F.coalesce("runs", F.array().cast(RUNS)))
    spans = F.transform(
        runs,
        lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (kind.window - 1)).alias("b")),
    )
    # Rows that repeat id and text have the same spans, which are kept once.
    return (
        back.select("id", "mark", spans.alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("id", "mark")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def _cut(docs: DataFrame, kind: Kind, id_type: str) -> DataFrame:
    def rows(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        text = pa.array(found["text"], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found["owner"]),
                pa.array(found["content"]),
                part.column("id").take(text),
                part.column("mark").take(text),
                pa.array(found["start"].astype(np.int32)),
                pa.array(found["n"].astype(np.int32)),
                pa.array(found["inner"]),
            ],
            names=["owner", "content", "id", "mark", "start", "n", "inner"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SEGMENT):
                size = pc.binary_length(part.column("text")).to_numpy()
                long = np.flatnonzero(size > 2 * SEGMENT)
                for i in long.tolist():
                    one = part.slice(i, 1)
                    for piece, before, starts in kind.segments(one.column("text")[0].as_buffer().to_pybytes(), SEGMENT, kind.window):
                        prefix, offsets = kind.symbols(pa.array([piece], pa.binary()))
                        offsets = np.minimum(offsets, starts + kind.window - 1)
                        found = slices(prefix, offsets, kind.window, kind.gram)
                        found["start"] = found["start"] + before
                        yield rows(one, found)
                if len(long):
                    part = part.filter(pa.array(size <= 2 * SEGMENT))
                if part.num_rows:
                    yield rows(part, slices(*kind.symbols(part.column("text")), kind.window, kind.gram))

    return docs.mapInArrow(kernel, f"owner long, content long, id {id_type}, mark long, start int, n int, inner boolean")


def _fetch(docs: DataFrame, mixed: DataFrame, kind: Kind, id_type: str) -> DataFrame:
    """The content of slices, from one document each."""
    wanted = mixed.groupBy(F.col("id").alias("of"), F.col("mark").alias("of_mark")).agg(
        F.collect_list(F.struct("owner", "content", "different", "start", "n")).alias("wanted")
    )
    same = docs["id"].eqNullSafe(wanted["of"]) & (docs["mark"] == wanted["of_mark"])
    # Rows that repeat id and text would give their slices several times.
    joined = docs.join(wanted, same).select("id", "mark", "text", "wanted")
    schema = f"owner long, content long, different long, id {id_type}, mark long, start int, n int, slice binary"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                lists = part.column("wanted")
                items = lists.flatten()
                size = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), size)
                start, n = items.field("start").to_numpy(), items.field("n").to_numpy()
                content, at = [], 0
                for text, k in zip(part.column("text").to_pylist(), size.tolist()):
                    get = kind.cutter(text)
                    for a, m in zip(start[at : at + k].tolist(), n[at : at + k].tolist()):
                        content.append(get(a, a + m + kind.window - 1))
                    at += k
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        items.field("owner"), items.field("content"), items.field("different"),
                        part.column("id").take(take), part.column("mark").take(take),
                        items.field("start"), items.field("n"), pa.array(content, pa.binary()),
                    ],
                    names=["owner", "content", "different", "id", "mark", "start", "n", "slice"],
                )

    return joined.mapInArrow(kernel, schema).dropDuplicates(["owner", "content"])


def _search_small(texts: DataFrame, kind: Kind, keep_first: bool) -> DataFrame:
    """Repeats among the slices of each owner; a kernel takes many owners at once."""
    # Bundles end between owners, after this many slices; small ones sort within the caches.
    limit = max(1, BUNDLE_BYTES // (2 * kind.window * kind.width))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in group_batches(batches, ["owner"], limit):
            numbers, size = kind.numbers(table.column("slice").to_pylist())
            n = table.column("n").to_numpy().astype(np.int64)
            begin = np.cumsum(size) - size
            start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            twice, later = kind.search(numbers, start, kind.window)
            runs = runs_of(later if keep_first else twice, n)
            owner, content = (table.column(c).combine_chunks() for c in ("owner", "content"))
            out = pa.RecordBatch.from_arrays([owner, content, runs], names=["owner", "content", "runs"])
            yield out.filter(pa.array(np.diff(runs.offsets.to_numpy()) > 0))

    ordered = texts.drop("different").repartition("owner").sortWithinPartitions("owner", "id", "mark", "start")
    return ordered.mapInArrow(kernel, f"owner long, content long, runs {RUNS}")


def _search_hot(texts: DataFrame, kind: Kind, keep_first: bool, id_type: str) -> DataFrame:
    """The same for owners with very many slices: windows are counted by a 128-bit hash."""
    schema = f"x long, y long, id {id_type}, mark long, place int, n long"

    def hashes(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        numbers, size = kind.numbers(table.column("slice").to_pylist())
        n = table.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(size) - size)[row] + within
        keys = mix(numbers.astype(np.uint64) + np.uint64(1))
        x, y = (span_hash(prefix_hash(k), start, start + kind.window) for k in (keys, mix(keys)))
        return row, within, x.view(np.int64), y.view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct windows of a batch, with the first of their occurrences."""
        for batch in batches:
            for part in chunks(batch, "slice"):
                row, within, x, y = hashes(part)
                keys, first, n = np.unique(np.stack([x, y]), axis=1, return_index=True, return_counts=True)
                take = pa.array(row[first], pa.int64())
                place = part.column("start").to_numpy()[row[first]] + within[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[0]), pa.array(keys[1]), part.column("id").take(take),
                        part.column("mark").take(take), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64)),
                    ],
                    names=["x", "y", "id", "mark", "place", "n"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "slice"):
                row, within, x, y = hashes(part)
                take = pa.array(row, pa.int64())
                place = part.column("start").to_numpy()[row] + within
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x), pa.array(y), *(part.column(c).take(take) for c in ("owner", "content", "id", "mark")),
                        pa.array(place.astype(np.int32)), pa.array(within.astype(np.int32)),
                    ],
                    names=["x", "y", "owner", "content", "id", "mark", "place", "within"],
                )

    # In this order the first of a batch's equal windows is the first by id and place.
    ordered = texts.sortWithinPartitions("id", "mark", "start")
    counted = ordered.mapInArrow(count, schema).groupBy("x", "y").agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "mark", "place")).alias("first")
    )
    windows = texts.mapInArrow(
        spread, f"x long, y long, owner long, content long, id {id_type}, mark long, place int, within int"
    )
    hit = windows.join(counted.filter("n > 1"), ["x", "y"])
    if keep_first:
        hit = hit.filter(~F.struct("id", "mark", "place").eqNullSafe(F.col("first")))
    one = F.struct(F.col("within").alias("a"), (F.col("within") + 1).alias("b"))
    return hit.groupBy("owner", "content").agg(F.collect_list(one).alias("runs"))


def class_levels(codes: np.ndarray, have: int, length: int) -> list[tuple[int, np.ndarray]]:
    """Order-preserving numbers of all strings of ``have``, twice as many, ... ``length`` symbols.

    Prefix doubling: a string's rank follows from the ranks of its first and last parts.  Near
    the end of the numbers the strings are cut short.
    """
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.uint64)
    out = [(have, ranks.astype(np.uint32))]
    while have < length:
        step = min(have, length - have)
        n = len(ranks)
        ahead = np.zeros(n, np.uint64)
        ahead[: n - step] = ranks[step:] + np.uint64(1)
        ranks = np.unique(ranks * np.uint64(n + 1) + ahead, return_inverse=True)[1].astype(np.uint64)
        have += step
        out.append((have, ranks.astype(np.uint32)))
    return out


def equal_classes(codes: np.ndarray, have: int, length: int) -> np.ndarray:
    """Order-preserving numbers of all strings of ``length`` symbols, from those of ``have``."""
    return class_levels(codes, have, length)[-1][1]


def join_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows ``(id, text, mark)`` with their spans, NULL where there are none."""
    right = spans.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "spans")
    same = docs["id"].eqNullSafe(right["of"]) & (docs["mark"] == right["of_mark"])
    return docs.join(right, same, "left").select(*docs.columns, "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, mark``; the mark tells rows apart that have one id but different texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
