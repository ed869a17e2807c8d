"""Exact repeats of word sequences by fixed-block anchors.

Slices of the corpus that may share windows meet in one task (see ``repeats``).  There every
slice is cut in reference blocks of ``(window + 1) // 2`` words that don't overlap; a window of
35 words holds a whole block of 18, wherever it begins.  The blocks are indexed, every rolling
window of a block's length probes the index, and hits are extended to both sides: the windows
around a hit are equal exactly if their first and last block-long parts are.  The runs of
repeated windows are the maximal repeats.

Defined results: a NULL or empty text has no words and nothing is removed; rows that repeat id
and text are copies of each other; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecprune.llm.repeats import HOT, Kind, equal_classes, join_spans, marked, merged, repeat_spans
from vecprune.llm.text import Words, chunks, covered, prefix_hash, repeats

WINDOW = 35
GRAM = 8
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = Words(column)
    return prefix_hash(words.hash), words.first


def word_segments(data: bytes, size: int, window: int) -> Iterator[tuple[bytes, int, int]]:
    """Pieces of a long text that end between words and overlap by a window."""
    low = before = 0
    while low < len(data):
        gap = _GAP.search(data, low + size)
        end = gap.start() if gap else len(data)
        # So many words more that the last word of the piece can start a window.
        reach = end
        for _ in range(window - 1):
            word = _WORD.search(data, reach)
            if word is None:
                break
            reach = word.end()
        starts = sum(1 for _ in _WORD.finditer(data, low, end))
        yield data[low:reach], before, starts
        low, before = end, before + starts


def _cutter(text: str):
    words = text.encode().split()
    return lambda a, b: b" ".join(words[a:b])


def _numbers(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words, so that equal words have equal numbers in every task."""
    words = Words(pa.array(contents, pa.binary()))
    return words.hash, words.count


def block_hits(numbers: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at ``start``: is it repeated, and is it repeated earlier?"""
    block = (window + 1) // 2
    parts = equal_classes(numbers, 1, block).astype(np.int64)
    # The index: parts at every block's place.  Probes: all rolling parts.
    reference = np.zeros(len(parts) + 1, bool)
    reference[parts[::block]] = True
    often = np.bincount(parts, minlength=len(parts) + 1) > 1
    hit = np.flatnonzero((reference & often)[parts])
    # Windows that hold a hit are candidates; extension compares both their ends.
    reach = window - block + 1
    near = covered(len(parts), np.maximum(hit - reach + 1, 0), reach)
    candidate = np.flatnonzero(near[start])
    at = start[candidate]
    keys = parts[at] * (len(parts) + 1) + parts[at + window - block]
    same, before = repeats(keys)
    twice, later = np.zeros(len(start), bool), np.zeros(len(start), bool)
    twice[candidate], later[candidate] = same, before
    return twice, later


def kind(window: int = WINDOW, gram: int = GRAM) -> Kind:
    return Kind(window, gram, 8, _symbols, word_segments, _cutter, _numbers, block_hits)


def removals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, gram: int = GRAM, keep_first: bool = False, hot: int = HOT,
) -> DataFrame:
    """Documents as ``id, text, spans``: what is to be removed, in words, maybe overlapping."""
    rows = marked(docs, id_col, text_col)
    spans = repeat_spans(rows, kind(window, gram), keep_first, hot)
    return join_spans(rows, spans)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            n_words, n_removed, sha = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                words, gone = text.encode().split(), merged(spans)
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def op4_anchors(spark, sf_dir: str) -> DataFrame:
    found = removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    id_type = found.schema["id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string"
    return found.select("id", "text", "spans").mapInArrow(_digest, schema)
