"""Language-model scores: a unigram base over words and an attention model over subwords.

*Counts.*  One pass counts words (by a 64-bit hash) and subword ids in the training documents;
counts are summed per task before the shuffle, and no table of words goes to the driver.  The
same pass takes all windows of the training documents for the model.

*Model.*  Ids with the most counts have a slot each, the rest share one, in which an id has its
own frequency; so a probability is given for every id.  Windows are dealt to shards by a hash of
their text and number; how many shards there are follows from the number of windows, and a shard
has its windows in the order of the hash.  On disk the ids of a text stand once, windows are made
from them on the way to the shards, and a shard is one compressed row that all rounds read.  Rounds of training run in parallel: a task descends
over a shard, and the shards' weights, of fixed size, are averaged by their windows.  So the model
depends on the documents alone, not on how they are partitioned.

*Scores.*  Texts are cut into windows that overlap by the context; every token is scored once.
Words with the highest counts (at most ``FREQUENT``, a bound on the broadcast) are looked up
in the tasks; the other words of a document are joined with their counts.

Defined results: a NULL or empty text is one end token; repeated rows are scored one by one; a
NULL id is in no held-out fold; if there is no training document all counts are zero; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.llm import attention as net
from vecprune.llm.bpe import Encoder, read_ranks
from vecprune.llm.langid import in_fold
from vecprune.llm.text import Words, chunks, mix, span_hash
from vecprune.session import ship_package
from vecprune.staging import drop_stage, stage_table

ROUNDS = 2
RATES = (0.02, 0.006)
FREQUENT = 1 << 19
HELD_WORDS = 1 << 20
REMEMBERED = 1_500_000
# Bytes of text read at once; the arrays for them take about fifty times as many.
CHUNK = 1 << 20
N_IDS = 1 << 16
END, BEFORE, PAD = N_IDS - 3, N_IDS - 2, N_IDS - 1
WORD, SUBWORD, WINDOW = 0, 1, 2
SHARD_WINDOWS = 1 << 17
# Windows that a task deals out at once.
DEALT_WINDOWS = 1 << 16
FED_WINDOWS = 1 << 13


class Subwords:
    """Subword ids of the words of a chunk; an end stands after every text.

    Each word is encoded with a blank before it.  The ids of words seen before are kept by the
    words' hashes; the new words of a chunk are encoded in one call.
    """

    def __init__(self, file: bytes) -> None:
        ranks = Encoder.parse(file)
        # A blank occurs only before a word.
        coder = tiktoken.Encoding("subwords", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.encode = coder.encode_ordinary
        self.opens = np.zeros(N_IDS, bool)
        self.opens[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def look_up(self, hashes: np.ndarray, words: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the words with these (sorted) hashes begin in ``flat``, and how many."""
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == hashes[there]
        new = np.flatnonzero(~there)
        if len(new):
            data = words.data.tobytes()
            spans = zip(words.start[index[new]].tolist(), words.end[index[new]].tolist())
            text = b" " + b" ".join([data[a:b] for a, b in spans])
            ids = np.array(self.encode(text.decode()), np.uint16)
            begin = np.flatnonzero(self.opens[ids])
            self.known = np.insert(self.known, at[new], hashes[new])
            self.begin = np.insert(self.begin, at[new], begin + len(self.flat))
            self.size = np.insert(self.size, at[new], np.diff(np.append(begin, len(ids))))
            self.flat = np.concatenate([self.flat, ids])
            at = np.searchsorted(self.known, hashes)
        return self.begin[at], self.size[at]

    def ids(self, column: pa.Array) -> Chunk:
        words = Words(column, lower=True)
        hashes, index, which = np.unique(words.hash, return_index=True, return_inverse=True)
        begin, size = self.look_up(hashes, words, index)
        flat = np.append(self.flat, np.uint16(END))
        begin, size = np.append(begin, len(flat) - 1), np.append(size, 1)
        # The words in order, with the end after each text's last word.
        sequence = np.insert(which, words.first[1:], len(hashes))
        n = size[sequence]
        place = np.cumsum(n) - n
        ids = flat[np.repeat(begin[sequence] - place, n) + np.arange(n.sum())]
        total = np.append(place, n.sum())
        text_end = words.first[1:] + np.arange(1, len(words.count) + 1)
        return Chunk(words, hashes, which, ids, np.concatenate([[0], total[text_end]]))


class Texts:
    """Ids of texts, one after the other, and the windows in them."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.offsets = ids, offsets
        size = np.diff(offsets)
        count = 1 + np.maximum(0, -(-(size - net.LENGTH) // net.STRIDE))
        self.owner = np.repeat(np.arange(len(size)), count)
        self.nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)

    def windows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``LENGTH + 1`` ids per window, the first being an input only, and which to score."""
        owner, nth = self.owner[pick], self.nth[pick]
        start = self.offsets[owner] + net.STRIDE * nth
        place = start[:, None] + np.arange(-1, net.LENGTH)
        end = self.offsets[owner + 1][:, None]
        ids = self.ids[np.clip(place, 0, len(self.ids) - 1)]
        ids[place < self.offsets[owner][:, None]] = BEFORE
        ids[place >= end] = PAD
        scored = place[:, 1:] < end
        scored[nth > 0, : net.CONTEXT] = False
        return ids, scored


class Chunk(Texts):
    def __init__(self, words: Words, hashes, which, ids: np.ndarray, offsets: np.ndarray) -> None:
        super().__init__(ids, offsets)
        self.words, self.hashes, self.which = words, hashes, which


_subwords: dict[bytes, Subwords] = {}


def _reader(file: bytes) -> Subwords:
    """The reader of a ranks file; a worker keeps it from task to task."""
    if file not in _subwords:
        _subwords.clear()
        _subwords[file] = Subwords(file)
    return _subwords[file]


def give_back() -> None:
    """Returns freed memory to the system: the executor and its other workers have one limit together."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def packed(longs: np.ndarray, ids: np.ndarray) -> bytes:
    """64-bit values and 16-bit ids, by their high and low bytes, in one zstd frame."""
    flat = np.ascontiguousarray(ids, np.uint16).ravel()
    halves = [(flat >> 8).astype(np.uint8).tobytes(), flat.astype(np.uint8).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([longs.astype(np.int64).tobytes(), *halves]))


def unpacked(blob: bytes, n_longs: int) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    high, low = np.frombuffer(data, np.uint8, offset=8 * n_longs).reshape(2, -1).astype(np.uint16)
    return np.frombuffer(data, np.int64, n_longs), high << 8 | low


def gather(train: DataFrame, file, text_col: str) -> DataFrame:
    """Counts and windows of the training documents.

    Rows are (WORD, hash, count), (SUBWORD, id, count) and (WINDOW, hash, NULL, ids).
    """
    return unfolded(gather_texts(train, file, text_col))


def windows_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and ids of the windows in packed texts, some at a time."""
    for batch in batches:
        for texts, blob in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            longs, ids = unpacked(blob, 2 * texts)
            found = Texts(ids, np.concatenate([[0], np.cumsum(longs[texts:])]))
            key = mix(longs[:texts].view(np.uint64)[found.owner] + mix(found.nth)).view(np.int64)
            for at in range(0, len(key), FED_WINDOWS):
                pick = np.arange(at, min(at + FED_WINDOWS, len(key)))
                yield key[pick], found.windows(pick)[0]


def windows_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same from a row for each window."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("key").to_numpy(), ids_of(batch.column("ids"), net.LENGTH + 1)


def unfolded(gathered: DataFrame) -> DataFrame:
    """The rows of ``gather``, in which windows are made from the texts' ids as they are read."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids in windows_of_texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), blobs_of(ids)], names=["key", "ids"])

    windows = gathered.filter(F.col("kind") == WINDOW).select("key", "ids").mapInArrow(kernel, "key long, ids binary")
    windows = windows.select(F.lit(WINDOW).alias("kind"), "key", F.lit(None).cast("long").alias("n"), "ids")
    return gathered.filter(F.col("kind") != WINDOW).unionByName(windows)


def gather_texts(train: DataFrame, file, text_col: str) -> DataFrame:
    """A stage table of counts and of texts as (WINDOW, number of texts, of windows, hashes and ids)."""
    schema = "kind int, key long, n long, ids binary"

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.binary())],
            names=["kind", "key", "n", "ids"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(file.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_rows = 0
        subwords = np.zeros(N_IDS, np.int64)
        for batch in batches:
            give_back()
            for part in chunks(batch, text_col, CHUNK):
                chunk = reader.ids(part.column(text_col))
                subwords += np.bincount(chunk.ids, minlength=N_IDS)
                held.append((chunk.hashes.view(np.int64), np.bincount(chunk.which, minlength=len(chunk.hashes))))
                held_rows += len(chunk.hashes)
                if held_rows > HELD_WORDS:
                    held = [_summed(held)]
                    held_rows = len(held[0][0])
                    if held_rows > HELD_WORDS // 2:
                        yield rows(WORD, *held[0])
                        held, held_rows = [], 0
                text = span_hash(chunk.words.prefix, chunk.words.offsets[:-1], chunk.words.offsets[1:])
                longs = np.concatenate([text.view(np.int64), np.diff(chunk.offsets)])
                columns = [[WINDOW], [len(text)], [len(chunk.owner)], [packed(longs, chunk.ids)]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "n", "ids"])
        if held:
            yield rows(WORD, *_summed(held))
        seen = np.flatnonzero(subwords)
        yield rows(SUBWORD, seen, subwords[seen])

    return stage_table(train.select(text_col).mapInArrow(kernel, schema), "lm-gathered")


def blobs_of(ids: np.ndarray) -> pa.Array:
    """Rows of 16-bit ids as bytes."""
    data = np.ascontiguousarray(ids, np.uint16)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (2 * data.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def ids_of(blobs: pa.Array, width: int) -> np.ndarray:
    """The rows again."""
    if not len(blobs):
        return np.zeros((0, width), np.uint16)
    at = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.uint16).reshape(-1, width)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.bincount(which, np.concatenate([n for _, n in held]), len(keys))
    return keys, n.astype(np.int64)


class Slots:
    """The slot of every id, and the id's log-probability within its slot."""

    def __init__(self, counts: np.ndarray, n_ids: int) -> None:
        """``counts`` of all ids of which those below ``n_ids`` and ``END`` can occur."""
        possible = np.append(np.arange(n_ids), END)
        ranked = possible[np.argsort(-counts[possible], kind="stable")]
        single, shared = ranked[: net.SLOTS - 1], ranked[net.SLOTS - 1 :]
        self.slot = np.full(N_IDS, net.SLOTS - 1, np.int64)
        self.slot[single] = np.arange(len(single))
        self.slot[BEFORE] = net.START
        self.within = np.zeros(N_IDS)
        self.within[shared] = np.log((counts[shared] + 0.5) / (counts[shared] + 0.5).sum())
        possible_counts = counts[possible].astype(float)
        self.counts = np.bincount(self.slot[possible], possible_counts, net.SLOTS)[: net.SLOTS]

    def of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of windows with padding as slot 0, and what is no padding."""
        real = windows != PAD
        return np.where(real, self.slot[windows], 0), real


def shards_of(source: DataFrame, windows_of, shards: int) -> DataFrame:
    """A stage table of ``shard, n, ids``: all windows of a shard by their keys, in one row.

    ``windows_of`` reads them from the batches of ``source``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key, ids = (np.concatenate(x) for x in zip(*held))
            shard = key % shards
            order = np.argsort(shard, kind="stable")
            number, first, n = np.unique(shard[order], return_index=True, return_counts=True)
            cuts = [order[a : a + m] for a, m in zip(first.tolist(), n.tolist())]
            blobs = pa.array([packed(key[cut], ids[cut]) for cut in cuts], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(number), pa.array(n), blobs], names=["shard", "n", "ids"])

        give_back()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for key, ids in windows_of(batches):
            held.append((key, ids))
            size += len(key)
            if size >= DEALT_WINDOWS:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, rows = None, [], []
        for batch in batches:
            for shard, n, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "ids"))):
                key, ids = unpacked(blob, n)
                keys.append(key)
                rows.append(ids.reshape(n, -1))
        # Equal keys are windows of equal texts, so this order is that of the data.
        key = np.concatenate(keys)
        ids = np.concatenate(rows)[np.argsort(key, kind="stable")]
        columns = [pa.array([shard], pa.int64()), pa.array([len(key)], pa.int64()), pa.array([packed(key[:0], ids)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "n", "ids"])

    schema = "shard long, n long, ids binary"
    dealt = source.select("key", "ids").mapInArrow(deal, schema).repartition(shards, "shard")
    return stage_table(dealt.groupBy("shard").applyInArrow(join, schema), "lm-shards")


def train_model(windows: DataFrame, slots: Slots, shard_windows: int = SHARD_WINDOWS) -> net.Params:
    """The model from windows as rows ``(key, ids)``."""
    shards = -(-windows.count() // shard_windows)
    return train_rounds(windows, windows_of_rows, shards, slots)


def train_rounds(source: DataFrame, windows_of, shards: int, slots: Slots) -> net.Params:
    """Rounds of parallel descent over shards of windows; after each their weights are averaged."""
    spark = source.sparkSession
    params = net.initial(slots.counts)
    part = 1024
    if not shards:
        return params
    dealt = shards_of(source, windows_of, shards)
    for rate in RATES[:ROUNDS]:
        sent = spark.sparkContext.broadcast((params, slots))

        def kernel(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            params, slots = sent.value
            # Training needs the room of the words that this worker remembers from the counts.
            _subwords.clear()
            for batch in batches:
                give_back()
                for shard, seen, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "ids"))):
                    ids, descent = unpacked(blob, 0)[1].reshape(seen, -1), net.Descent(params, rate)
                    for at in range(0, seen, FED_WINDOWS):
                        window, real = slots.of(ids[at : at + FED_WINDOWS])
                        descent.feed(window, real[:, 1:].astype(np.float32))
                    flat = net.flat(descent.end()).astype(np.float64) * seen
                    cut = [flat[i : i + part].tobytes() for i in range(0, len(flat), part)]
                    columns = [np.arange(len(cut)), np.full(len(cut), shard), np.full(len(cut), seen)]
                    arrays = [pa.array(c.astype(np.int64)) for c in columns]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(cut, pa.binary())], names=["part", "shard", "n", "weights"])

        def total(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, found = 0, []
            for batch in rows:
                for part, shard, n, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "n", "weights"))):
                    number = part
                    found.append((shard, n, weights))
            # In the order of the shards, so that the sum is the same each time.
            found.sort()
            mean = sum(np.frombuffer(w) for *_, w in found) / sum(n for _, n, _ in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())],
                names=["part", "weights"],
            )

        schema = "part long, shard long, n long, weights binary"
        made = dealt.mapInArrow(kernel, schema).groupBy("part").applyInArrow(total, "part long, weights binary")
        params = net.unflat(np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(made.collect())]))
    drop_stage(dealt)
    return params


def frequent_words(counts: DataFrame, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of all words with the least count or more, at most ``limit`` of them."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > limit:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 62
    table = counts.filter(step >= least).toArrow()
    order = np.argsort(table.column("key").to_numpy())
    return table.column("key").to_numpy()[order], table.column("n").to_numpy()[order], least


def scores(
    docs: DataFrame, train: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: tokens, known tokens, base score and score of the model."""
    spark = docs.sparkSession
    ship_package(spark)
    content = read_ranks(ranks_path)
    n_ids = 1 + max(Encoder.parse(content).values())
    if n_ids > END:
        raise ValueError("ids of the tokenizer must fit 16 bits")
    file = spark.sparkContext.broadcast(content)
    gathered = gather_texts(train, file, text_col)
    found = gathered.filter(F.col("kind") == SUBWORD).groupBy("key").agg(F.sum("n")).collect()
    subwords = np.zeros(N_IDS, np.int64)
    for key, n in found:
        subwords[key] = n
    slots = Slots(subwords, n_ids)
    counts = stage_table(
        gathered.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "lm-counts"
    )
    texts = gathered.filter(F.col("kind") == WINDOW)
    shards = -(-(texts.agg(F.sum("n")).first()[0] or 0) // SHARD_WINDOWS)
    # One kernel makes windows and deals them: a second one would be a second worker for each task.
    params = train_rounds(texts, windows_of_texts, shards, slots)
    drop_stage(gathered)
    words = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = int(subwords[END])
    train_tokens, distinct = (words.n or 0) + ends, words.v + (ends > 0)
    keys, n, least = frequent_words(counts)
    below = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    sent = spark.sparkContext.broadcast((slots, params, keys, n))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, params, keys, n = sent.value
        reader, scorer = _reader(file.value), net.Scorer(params)
        logs = np.append(np.log10(n + 0.5), 0.0)
        end_log = np.log10(ends + 0.5)
        for batch in batches:
            give_back()
            for part in chunks(batch, text_col, CHUNK):
                chunk = reader.ids(part.column(text_col))
                texts = part.num_rows
                model = np.zeros(texts)
                # The context of a later window is scored in the window before.
                for first, some in ((0, chunk.nth == 0), (net.CONTEXT, chunk.nth > 0)):
                    among = np.flatnonzero(some)
                    for at in range(0, len(among), 4096):
                        pick = among[at : at + 4096]
                        ids, scored = chunk.windows(pick)
                        slot, _ = slots.of(ids)
                        value = scorer.score(slot[:, :-1], slot[:, 1:], first) + slots.within[ids[:, 1 + first :]]
                        np.add.at(model, chunk.owner[pick], (value * scored[:, first:]).sum(axis=1))
                # The base: words in the broadcast here, the others later.
                mine = chunk.hashes.view(np.int64)
                spot = np.searchsorted(keys, mine)
                spot[spot == len(keys)] = 0
                hit = keys[spot] == mine if len(keys) else np.zeros(len(mine), bool)
                spot = np.where(hit, spot, len(n))
                owner, known = chunk.words.owner, hit[chunk.which]
                base = np.bincount(owner, logs[spot][chunk.which], texts) + end_log
                rare = np.bincount(owner, ~known, texts).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col),
                        pa.array(chunk.words.count + 1),
                        pa.array(chunk.words.count - rare + (ends > 0)),
                        pa.array(base),
                        pa.array(model / np.log(10)),
                        pa.LargeListArray.from_arrays(
                            np.concatenate([[0], np.cumsum(rare)]), pa.array(mine[chunk.which[~known]])
                        ).cast(pa.list_(pa.int64())),
                    ],
                    names=[id_col, "n_tokens", "n_known", "base", "score", "rare"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, base double, score double, rare array<long>"
    marked = docs.select(id_col, text_col).mapInArrow(kernel, schema)
    marked = stage_table(marked.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    # A word without a count has c = 0.
    others = counts.filter(F.floor(F.log2("n") * 8).cast("int") < least)
    pairs = marked.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = (
        pairs.join(others, "key", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"),
        )
    )
    whole = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)
    return marked.drop("rare").join(rare, "row", "left").select(
        id_col,
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        whole.alias("base_score"),
        "score",
    )


def op9_attention_scores(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = in_fold("doc_id", 5, 1)
    found = scores(docs, docs.filter(~held_out), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
