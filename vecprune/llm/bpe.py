"""Byte-level BPE by monoid tree reduction.

Encodings form a monoid: the encodings of two neighbouring byte strings have a join, the
encoding of both together, and the join is associative.  ``Encoder.encode`` takes a string
apart in halves and joins upwards.  A join encodes a window of a few tokens around the boundary
anew and lets it grow until its outermost tokens come out as they were.  Then all tokens
outside are settled: a token sequence is the encoding of its bytes exactly if each two
neighbours are the encoding of theirs, and every pair of neighbours is one of the left
encoding, of the right one, or of the window's.  (This needs each token to be the encoding of
its own bytes, which is checked when the ranks are loaded.)

Ranks are a small file, read by the driver (at most ``MAX_RANK_BYTES``) and broadcast.

Defined results: a NULL or empty text has no ids; repeated rows are encoded one by one; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pathlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecprune.llm.text import add_columns, chunks
from vecprune.session import ship_package

MAX_RANK_BYTES = 16 << 20
# Values that a worker remembers of each kind.
PIECES, HALVES, WINDOWS = 400_000, 200_000, 300_000
SHORT_WINDOW = 48
LEAF_IDS = 4096
NEVER = 1 << 62


class UnreachableToken(ValueError):
    """A token that is not the encoding of its own bytes."""


class _Memo(dict):
    """Computes missing values and remembers at most ``limit`` of them, the latest used ones."""

    def __init__(self, make, limit: int, longest: int = 64) -> None:
        self.make, self.half, self.longest = make, limit // 2, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.windows = _Memo(self._merge, WINDOWS)
        self.halves = _Memo(self._encode, HALVES)
        self.pieces = _Memo(self._piece, PIECES)
        self.split = regex.compile(pattern).findall

    @staticmethod
    def parse(file: bytes) -> dict[bytes, int]:
        pairs = (line.split() for line in file.splitlines() if line)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}

    def check(self) -> None:
        for token, rank in self.ranks.items():
            if self._merge(token) != (rank,):
                raise UnreachableToken(repr(token))

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """The plain algorithm for a window: the lowest rank first, leftmost among equals."""
        if len(data) > SHORT_WINDOW:
            return self._merge_long(data)
        rank, n = self.ranks.get, len(data)
        cuts = list(range(n + 1))
        pairs = [rank(data[i : i + 2], NEVER) for i in range(n - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            del cuts[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(data[cuts[at] : cuts[at + 2]], NEVER)
            if at:
                pairs[at - 1] = rank(data[cuts[at - 1] : cuts[at + 1]], NEVER)
        return tuple([self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of the pairs and linked parts."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if end[at] < n:
                stop = end[end[at]]
                rank = ranks.get(data[at:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, stop))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, at, stop = heapq.heappop(heap)
            # Stale if the part has been merged away or either half has grown meanwhile.
            if end[at] == 0 or end[at] >= n or end[at] >= stop or end[end[at]] != stop:
                continue
            gone = end[at]
            end[at], end[gone] = stop, 0
            if stop < n:
                before[stop] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return tuple(out)

    def _encode(self, data: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(data)
        if rank is not None:
            return (rank,)
        half = len(data) // 2
        return self.join(self.halves[data[:half]], self.halves[data[half:]])

    def encode(self, data: bytes) -> tuple[int, ...]:
        return self._encode(data) if data else ()

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            window = b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j]))
            ids = self.windows[window]
            left_stable = i == len(left) or ids[0] == left[-i]
            right_stable = j == len(right) or ids[-1] == right[j - 1]
            if left_stable and right_stable:
                return left[: len(left) - i] + ids + right[j:]
            i = i if left_stable else min(2 * i, len(left))
            j = j if right_stable else min(2 * j, len(right))

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode(piece.encode()), "<u4").tobytes()

    def encode_text(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; matches of the pattern don't join."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of leaves of ids, concatenated pairwise up the tree."""
        at = np.frombuffer(ids, "<u4").tolist()
        leaves = [
            b"".join(map(self.bytes_of.__getitem__, at[i : i + LEAF_IDS]))
            for i in range(0, len(at), LEAF_IDS)
        ]
        while len(leaves) > 1:
            odd = leaves[-1:] if len(leaves) % 2 else []
            leaves = [a + b for a, b in zip(leaves[::2], leaves[1::2])] + odd
        return leaves[0] if leaves else b""


_encoders: dict[tuple[bytes, str], Encoder] = {}


def encoder(file: bytes, pattern: str) -> Encoder:
    """The encoder of a ranks file; a worker keeps it from task to task."""
    key = (hashlib.sha256(file).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Encoder.parse(file), pattern)
    return _encoders[key]


def read_ranks(path: str) -> bytes:
    file = pathlib.Path(path).read_bytes()
    if len(file) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is too large for a broadcast")
    return file


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents with ``ids`` (array of int)."""

    def ids(coder: Encoder, texts: list[str]) -> dict:
        return {"ids": _id_lists([coder.encode_text(t) for t in texts])}

    return _mapped(docs, ranks_path, pattern, id_col, text_col, "ids array<int>", ids)


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """The texts of ``ids``; bytes that are no UTF-8 become replacement characters."""
    ship_package(encoded.sparkSession)
    file = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file.value, "")
        for batch in batches:
            texts = [
                coder.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace")
                for x in batch.column("ids").to_pylist()
            ]
            yield add_columns(batch, [id_col], text=pa.array(texts, pa.string()))

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(kernel, f"`{id_col}` {kind}, text string")


def token_digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Digests of the ids of each document and of the bytes decoded from them; the ids on demand."""

    def digests(coder: Encoder, texts: list[str]) -> dict:
        blobs = [coder.encode_text(text) for text in texts]
        decoded_sha = [hashlib.sha256(coder.decode(ids)).hexdigest() for ids in blobs]
        out = {
            "n_tokens": pa.array([len(ids) // 4 for ids in blobs], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids in blobs], pa.string()),
            "decoded_sha256": pa.array(decoded_sha, pa.string()),
        }
        return out | {"ids": _id_lists(blobs)} if with_ids else out

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _mapped(docs, ranks_path, pattern, id_col, text_col, columns, digests)


def _id_lists(blobs: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
    flat = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _mapped(docs, ranks_path, pattern, id_col, text_col, columns, make) -> DataFrame:
    ship_package(docs.sparkSession)
    content = read_ranks(ranks_path)
    Encoder(Encoder.parse(content), pattern).check()
    file = docs.sparkSession.sparkContext.broadcast(content)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file.value, pattern)
        for batch in batches:
            for part in chunks(batch, text_col):
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                yield add_columns(part, [id_col], **make(coder, texts))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, {columns}")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
