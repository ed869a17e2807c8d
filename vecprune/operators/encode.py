"""Items to vectors: a user's encoder, or hashed bags of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.operators.kernels import to_lists, unit_rows

# Words that are hashed at once, so that the numbers of a step stay in the processor cache, and the
# longest word in bytes that fills a single block of MD5.
HASHED_WORDS, BLOCK_BYTES = 1 << 13, 55
# Text whose words are counted at once; the arrays for them take about twenty times as many.
COUNTED_BYTES = 1 << 21

# Contents of a call of the encoder, about.
CALL_BYTES = 8 << 20

_encoders: dict[str, Callable] = {}


def _worker_encoder(digest: str, make_encoder: Callable) -> Callable:
    """The encoder of a factory; a Python worker makes it once and keeps it from task to task."""
    if digest not in _encoders:
        # A worker serves one encoder at a time, as they may be large.
        _encoders.clear()
        _encoders[digest] = make_encoder()
    return _encoders[digest]


def _calls(contents: pa.Array, limit: int) -> Iterator[slice]:
    """Stretches of contents of about ``limit`` bytes together, one item at least."""
    kinds = (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)
    if not any(is_kind(contents.type) for is_kind in kinds):
        yield slice(0, len(contents))
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(contents), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(contents):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield slice(at, end)
        at = end


def embed(
    df: DataFrame,
    id_col: str,
    content_col: str,
    make_encoder: Callable[[], Callable[[Sequence], np.ndarray]],
    *,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """``(id, embedding)`` from a user-supplied encoder, normalized.

    ``make_encoder`` returns a function from a batch of contents to a matrix with one row each.
    It runs once per Python worker, whatever the number of tasks; factories are told apart by
    what they are pickled to.  A batch has about ``call_bytes`` of text or bytes.
    """
    digest = hashlib.sha256(cloudpickle.dumps(make_encoder)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _worker_encoder(digest, make_encoder)
        for batch in batches:
            for some in _calls(batch.column(1), call_bytes):
                part = batch.slice(some.start, some.stop - some.start)
                matrix = np.asarray(encode(part.column(1).to_pylist()), dtype=np.float64)
                if matrix.ndim != 2 or len(matrix) != part.num_rows:
                    raise ValueError("the encoder must return one vector per item")
                vectors = to_lists(unit_rows(matrix)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], [id_col, "embedding"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, content_col).mapInArrow(run, f"`{id_col}` {id_type}, embedding array<float>")


# MD5: rotations, constants and the word read by each step.
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_READ = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """First 8 hex digits of the MD5 of messages of a single block, as numbers; ``blocks`` has 16 rows
    of 32-bit words, and a column per message."""
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(blocks.shape[1], v) for v in start)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += blocks[_READ[i]]
        f += _ADDED[i]
        a, d, c = d, c, b
        b = b + ((f << _TURNS[i]) | (f >> (np.uint32(32) - _TURNS[i])))
    return (a + start[0]).byteswap()


def _bucket(word: str | bytes, dim: int) -> int:
    word = word.encode() if isinstance(word, str) else word
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big") % dim


def _buckets(words: pa.Array, dim: int) -> np.ndarray:
    """``_bucket`` of each word, many words at once."""
    words = words.cast(pa.binary())
    _, offsets, content = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    content = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    length = np.diff(at)
    out = np.empty(len(words), np.int64)
    short = np.flatnonzero(length <= BLOCK_BYTES)
    for lo in range(0, len(short), HASHED_WORDS):
        some = short[lo : lo + HASHED_WORDS]
        size = length[some]
        row = np.repeat(np.arange(len(some)), size)
        column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        padded = np.zeros((len(some), 64), np.uint8)
        padded[row, column] = content[np.repeat(at[some], size) + column]
        padded[np.arange(len(some)), size] = 0x80
        blocks = padded.view("<u4")
        blocks[:, 14] = size * 8
        out[some] = _md5_heads(np.ascontiguousarray(blocks.T)) % dim
    for i in np.flatnonzero(length > BLOCK_BYTES):
        out[i] = _bucket(content[at[i] : at[i + 1]].tobytes(), dim)
    return out


def _bag_counts(dim: int, normalize: bool):
    def count(texts: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        # Only the different words are hashed; what is between two blanks counts in a bucket of its own.
        bucket = np.where(pc.binary_length(words.dictionary).to_numpy() > 0, _buckets(words.dictionary, dim), dim)
        cells = bucket[words.indices.to_numpy(zero_copy_only=False)]
        cells += np.repeat(np.arange(len(texts)) * (dim + 1), np.diff(split.offsets.to_numpy()))
        counts = np.bincount(cells, minlength=len(texts) * (dim + 1)).reshape(-1, dim + 1)[:, :dim].astype(np.float64)
        return to_lists(unit_rows(counts)) if normalize else to_lists(counts).cast(pa.list_(pa.float32()))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # A batch holds thousands of texts; their words are never all there together.
            parts = [count(texts.slice(p.start, p.stop - p.start)) for p in _calls(texts, COUNTED_BYTES)]
            yield pa.concat_arrays(parts) if parts else count(texts)

    # Declared nondeterministic so that no optimizer rule (a filter on the result, an
    # explode of it) makes Spark encode a text twice.
    udf = F.arrow_udf(run, "array<double>" if normalize else "array<float>")
    return udf.asNondeterministic()


def hash_encoder(
    df: DataFrame, text_col: str = "text", dim: int = 256, *, normalize: bool = True
) -> DataFrame:
    """Add ``embedding``: counts of the lower-case words of the whole text, each word in
    bucket ``first 8 hex digits of md5 mod dim``.

    Narrow, so it never shuffles; batches are bounded in bytes by
    ``spark.sql.execution.arrow.maxBytesPerBatch``.  With ``normalize=False`` the plain
    counts come as floats, exact and half the size; every operator that compares vectors
    normalizes them itself.
    """
    text = F.coalesce(F.lower(F.col(text_col)), F.lit(""))
    return df.withColumn("embedding", _bag_counts(dim, normalize)(text))
