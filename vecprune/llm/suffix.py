"""Exact repeats of byte strings by suffix arrays and longest previous factors.

Slices of the corpus that may share windows meet in one task (see ``repeats``).  There a suffix
array of the joined slices is built by prefix doubling, cut at the window's length, and the
common prefixes of neighbours follow from the classes of each doubling.  The previous and the next
smaller position in suffix order give every position's longest previous factor: its longest
earlier match.  A window has an earlier copy if the factor reaches its length, and is repeated if
it has one or, by larger positions, a later one.

Two results: all copies go (``keep_first=False``), or the later ones only.

Defined results: a NULL or empty text has no bytes and no spans; rows that repeat id and text are
copies of each other; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecprune.llm.repeats import HOT, Kind, class_levels, join_spans, marked, merged, repeat_spans
from vecprune.llm.text import byte_hashes, chunks, text_bytes

WINDOW = 400
GRAM = 64


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return byte_hashes(data), offsets


def _cutter(text: str):
    data = text.encode()
    return lambda a, b: data[a:b]


def _numbers(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(contents), np.uint8), np.array([len(c) for c in contents], np.int64)


def byte_segments(data: bytes, size: int, window: int) -> Iterator[tuple[bytes, int, int]]:
    """Pieces of a long text that overlap by a window, so that each start is in one of them."""
    for low in range(0, len(data), size):
        yield data[low : low + size + window - 1], low, size


def common_prefixes(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes at ``a`` and ``b``, up to ``most``.

    ``levels`` are (length, classes of all strings of this length), the last of ``most``.
    """
    out = np.zeros(len(a), np.int64)
    whole = levels[-1][1]
    same = whole[a] == whole[b]
    out[same] = most
    n = len(whole)
    rest = np.flatnonzero(~same)
    # Binary lifting: a length is the sum of different levels.
    for length, classes in reversed(levels[:-1]):
        x, y = a[rest] + out[rest], b[rest] + out[rest]
        inside = (x < n) & (y < n)
        more = np.zeros(len(rest), bool)
        more[inside] = classes[x[inside]] == classes[y[inside]]
        out[rest[more]] += length
    return np.minimum(out, most)


def nearest_smaller(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, the common prefix with the nearest one before it that
    has a smaller place, 0 without one; ``common[i]`` is that of suffixes ``i - 1`` and ``i``.

    Every suffix looks at its neighbour; while that has a larger place, it goes on to where that
    one has come, so the ways double.
    """
    n = len(places)
    to = np.arange(n) - 1
    least = common.copy()
    active = np.flatnonzero(to >= 0)
    while True:
        active = active[to[active] >= 0]
        active = active[places[to[active]] > places[active]]
        if not len(active):
            break
        over = to[active]
        least[active] = np.minimum(least[active], least[over])
        to[active] = to[over]
    return np.where(to >= 0, least, 0)


def longest_factors(numbers: np.ndarray, start: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix at ``start`` its longest previous and its longest later factor, up to ``most``.

    In suffix order the longest match at a smaller place is with the previous or with the next
    suffix that has one; with larger places it is the same for later matches.
    """
    ends = np.zeros(len(numbers) + 8, np.uint64)
    ends[: len(numbers)] = numbers
    packed = np.zeros(len(numbers), np.uint64)
    first = min(8, most)
    for i in range(first):
        packed = packed << np.uint64(8) | ends[i : i + len(numbers)]
    # Below the first doubling the packed bytes are classes themselves.
    below = [(1 << i, packed >> np.uint64(8 * (first - (1 << i)))) for i in range(3) if 1 << i < first]
    levels = below + class_levels(packed, first, most)
    order = np.lexsort((start, levels[-1][1][start]))
    places = start[order]
    common = np.zeros(len(start), np.int64)
    common[1:] = common_prefixes(levels, places[:-1], places[1:], most)
    after = np.append(common[1:], 0)[::-1]
    out = []
    for sign in (1, -1):
        before = nearest_smaller(sign * places, common)
        beyond = nearest_smaller(sign * places[::-1], after)[::-1]
        found = np.zeros(len(start), np.int64)
        found[order] = np.maximum(before, beyond)
        out.append(found)
    return out[0], out[1]


def previous_factors(numbers: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at ``start``: is it repeated, and has it an earlier match, of the window's length?"""
    earlier, further = longest_factors(numbers, start, window)
    return (earlier >= window) | (further >= window), earlier >= window


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(window, gram, 1, _symbols, byte_segments, _cutter, _numbers, previous_factors)


def removals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, keep_first: bool = False, hot: int = HOT,
) -> DataFrame:
    """Documents as ``id, text, spans``: what is to be removed, in bytes, maybe overlapping."""
    rows = marked(docs, id_col, text_col)
    spans = repeat_spans(rows, kind(window, gram), keep_first, hot)
    return join_spans(rows, spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                data, gone, at = text.encode(), merged(spans), 0
                sha = hashlib.sha256()
                for a, b in gone:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(b - a for a, b in gone))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())],
                names=["doc_id", *out],
            )


def op3_suffix(spark, sf_dir: str) -> DataFrame:
    found = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    id_type = found.schema["id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.select("id", "text", "spans").mapInArrow(_digest, schema)
