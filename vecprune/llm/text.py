"""Words and rolling hashes of whole texts, as numpy arrays over Arrow batches.

A word is a maximal run of characters other than ``\\x20`` and ``\\x09-\\x0D``.  Those bytes
never occur inside a multi-byte UTF-8 character, so words are found on bytes.  A NULL text
counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_KEYS = np.random.default_rng(20240501).integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest input so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i`` modulo 2**64, with a leading zero."""
    up, _ = _POWERS.until(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal content gives equal hashes wherever it stands."""
    _, down = _POWERS.until(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_KEYS[data])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, a text never being cut."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    at = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    for a, b in zip(at, [*at[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of the texts in them."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within a text.

    The third array tells for each text its first run, with the number of runs at the end.
    """
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before[edge], after[edge - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


class Words:
    """The words of a chunk of texts: byte spans, owners and 64-bit hashes."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = text_bytes(column)
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + np.where(upper, np.uint8(32), np.uint8(0))
        self.start, self.end, self.first = runs(~_SPACE[self.data], self.offsets)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.prefix = byte_hashes(self.data)
        self.hash = span_hash(self.prefix, self.start, self.end)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=lead[1:])
        return lead[self.end] - lead[self.start]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``n`` words of one text."""
        at = np.arange(max(len(self.hash) - n + 1, 0))
        at = at[self.owner[at] == self.owner[at + n - 1]] if len(at) else at
        if not hasattr(self, "_gram_prefix"):
            self._gram_prefix = prefix_hash(self.hash)
        return at, span_hash(self._gram_prefix, at, at + n)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[self.first])


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``length`` places from one of ``start``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once, and did it occur before?"""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_copy, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_copy[order[1:][same]] = True
    any_copy[order[:-1][same]] = True
    return any_copy, later


def add_columns(batch: pa.RecordBatch, names: list[str], **values) -> pa.RecordBatch:
    """The named columns of a batch and new ones."""
    arrays = {name: batch.column(name) for name in names} | {
        name: value if isinstance(value, pa.Array) else pa.array(value) for name, value in values.items()
    }
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
