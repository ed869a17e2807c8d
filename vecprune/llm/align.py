"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often.

*Links.*  Token ends of both tokenizers cut a text in stretches, each of which lies in one token
of either; so a stretch is a link, and both tokenizers' common ends cut the tokens into groups.

*Pieces.*  Where both tokenizers always cut before a single blank between letters or signs
(up to U+07FF), which their files tell, a text is the sequence of its pieces between such blanks; a
worker aligns each different piece once and remembers it, in bounded memory.  Otherwise, and in
scripts without blanks, a piece is as long as the text.

*Spilled runs.*  A task packs the links of its documents into records (pair, document, times).
When its buffer is full, the records are sorted, dealt by the B id into ``RADIX`` parts and
written as zstd runs to a stage table: a directory of pairs with their links, and the documents.

*Counting.*  Runs are dealt to tasks by part and split.  There the directories, sorted with the B
side first, go through a k-way merge: a heap holds the ends of the runs' present blocks, and all
entries up to the least of them are summed.  Sums of the splits are added by Spark, and the
largest count of every B id is marked.

*Contributions.*  The counts of a part are packed in zstd blocks, and every run of the part is
streamed past them; what it adds to its documents is summed per document.  A pair or a B id with
very many links is spread over the splits, and no task holds more than the counts of a part and
one run.

Defined results: a text that is NULL or empty, or that a tokenizer does not give back byte by
byte, has no tokens; repeated rows are counted one by one; NULL ids stay; an empty table gives an
empty result; other columns play no part.  A text is encoded as a whole, so the longest one has
to fit a worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json as jsons
import os
import pathlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecprune.llm.text import chunks
from vecprune.session import ship_package
from vecprune.staging import stage_table

RADIX = 16
RUN_LINKS = 1 << 21
RUN_DOCS = 1 << 16
RUNS_PER_SPLIT = 128
BLOCK = 1 << 12
COUNTS_PER_BLOCK = 1 << 18
CHUNK = 1 << 20
# What a worker remembers of pieces, and what one takes besides its text, links and groups, about.
MEMO_BYTES = 96 << 20
PIECE_BYTES = 280
BLOCK_PIECES = 1024
MAX_FILE_BYTES = 64 << 20


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, by their public rule.

    Printable bytes are their own letters; the others take the code points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokens:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, json: bytes, model: bytes) -> None:
        # Tasks are the parallel part; threads of a library would take other tasks' cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        # An entry outside the byte alphabet (a special token) has bytes of no text.
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for entry, n in self.a.get_vocab().items():
            if all(c in letters for c in entry):
                self.a_bytes[n] = bytes(letters[c] for c in entry)
        self.b_bytes = []
        for n in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(n)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.apart = a_apart(json) and b_apart(model)

    def encode(self, blocks: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
        """For runs of blocks: ids of both sides and the sizes of the pieces they are of.

        A block's pieces, each with a blank before it, are encoded as one text.  Pieces that a
        tokenizer does not give back byte by byte get no ids.
        """
        spaced = [b"".join(block) for block in blocks]
        texts = [data.decode() for data in spaced]
        left = self.a.encode_batch_fast(texts, add_special_tokens=False)
        right = self.b.encode([t[1:] for t in texts], num_threads=1)
        none, found = np.zeros(0, np.int64), []
        for block, data, a, b in zip(blocks, spaced, left, right):
            ids = a.ids
            same = b"".join(map(self.a_bytes.__getitem__, ids)) == data
            if same and b"".join(map(self.b_bytes.__getitem__, b)) == data:
                found.append((np.array(ids, np.int64), np.array(b, np.int64), list(map(len, block))))
            elif len(block) > 1:
                found += self.encode([[piece] for piece in block])
            else:
                found.append((none, none, [0]))
        return found


def a_apart(json: bytes) -> bool:
    """Does the tokenizer cut before each single blank, in any text?

    Byte-level patterns take a blank only as the first character of what is no blank space.
    """
    file = jsons.loads(json)
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = not any(file.get(x) for x in ("normalizer", "truncation", "padding"))
    plain = plain and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    # Special tokens are plain text here; other added ones are matched before the pattern.
    plain = plain and model["type"] == "BPE" and all(x["special"] for x in file.get("added_tokens") or ())
    return plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def b_apart(model: bytes) -> bool:
    """The same of a sentencepiece model: no entry goes on after a character with a blank."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    file = sentencepiece_model_pb2.ModelProto()
    file.ParseFromString(model)
    trainer, rules = file.trainer_spec, file.normalizer_spec
    plain = trainer.model_type == trainer.BPE and not trainer.treat_whitespace_as_suffix
    plain = plain and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
    plain = plain and rules.add_dummy_prefix and rules.escape_whitespaces
    return plain and not any(re.search("[^▁]▁", x.piece) for x in file.pieces)


_DIGITS = np.array([list(str(n).ljust(5).encode()) for n in range(1 << 16)], np.uint8)
_N_DIGITS = np.array([len(str(n)) for n in range(1 << 16)])


class Aligned:
    """Links and groups of pieces, whose bytes stand one after the other."""

    def __init__(self, tokens: Tokens, encoded: list[tuple[np.ndarray, np.ndarray, list[int]]]) -> None:
        size = np.array([n for *_, sizes in encoded for n in sizes], np.int64)
        a_ids = self.a_ids = np.concatenate([a for a, *_ in encoded])
        b_ids = self.b_ids = np.concatenate([b for _, b, _ in encoded])
        a_end, b_end = np.cumsum(tokens.a_size[a_ids]), np.cumsum(tokens.b_size[b_ids])
        ends = np.cumsum(size)
        self.n_a, self.n_b = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (a_end, b_end))
        total = int(a_end[-1]) if len(a_end) else 0
        ends_a, ends_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        ends_a[a_end], ends_b[b_end] = True, True
        stretch = np.flatnonzero(ends_a | ends_b)
        link_a, link_b = np.searchsorted(a_end, stretch), np.searchsorted(b_end, stretch)
        of_a = np.repeat(np.arange(len(size)), self.n_a)
        self.pair = (b_ids[link_b] << 16 | a_ids[link_a]).astype(np.uint32)
        common = np.flatnonzero(ends_a & ends_b)
        self.n_groups = np.bincount(of_a[np.searchsorted(a_end, common)], minlength=len(size))
        self.n_links = np.bincount(of_a[link_a], minlength=len(size))
        self.group_a, self.group_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)

    def group_texts(self) -> list[bytes]:
        """Each piece's groups as text."""
        group_a, group_b = self.group_a, self.group_b
        n_groups = len(group_a) and int(group_a[-1]) + 1
        before_b = np.searchsorted(group_b, np.arange(n_groups))  # B tokens before each group
        up_to_a = np.searchsorted(group_a, np.arange(n_groups), side="right")
        # Of each group first the A tokens, then the B tokens.
        place = np.empty(len(group_a) + len(group_b), np.int64)
        ids, sign = np.empty_like(place), np.empty(len(place), np.uint8)
        at_a, at_b = np.arange(len(group_a)) + before_b[group_a], np.arange(len(group_b)) + up_to_a[group_b]
        ids[at_a], ids[at_b] = self.a_ids, self.b_ids
        for at, group, end in ((at_a, group_a, b"|"), (at_b, group_b, b";")):
            last = np.append(group[1:] != group[:-1], True)[: len(group)]
            sign[at] = np.where(last, end[0], ord(","))
        size = _N_DIGITS[ids] + 1
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        for k in range(5):
            some = np.flatnonzero(size > k + 1)
            out[end[some] - size[some] + k] = _DIGITS[ids[some], k]
        out[end - 1] = sign
        data = out.tobytes()
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [data[x : y - 1] if y > x else b"" for x, y in zip(bounds, bounds[1:])]


# First bytes of characters of two bytes from U+00C0 on; none of these is a blank of any kind.
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True
_LAST = np.zeros(256, bool)
_LAST[0x21:0x7F] = True
_FIRST = _TWO | _LAST
_FIRSTS, _LASTS, _TWOS = (frozenset(np.flatnonzero(x).tolist()) for x in (_FIRST, _LAST, _TWO))


def piece_starts(data: np.ndarray, starts: np.ndarray, apart: bool) -> np.ndarray:
    """Where pieces begin in texts that begin at ``starts``: there, and before the blanks that cut."""
    if not apart or len(data) < 3:
        return starts
    first, last = _FIRST[data], _LAST[data]
    last[1:] |= _TWO[data[:-1]]
    cuts = np.zeros(len(data), bool)
    cuts[1:-1] = last[:-2] & (data[1:-1] == 0x20) & first[2:]
    cuts[starts] = True
    return np.flatnonzero(cuts)


def in_blocks(pieces: list[bytes], apart: bool) -> list[list[bytes]]:
    """Pieces that tokenizers cut off wherever they stand, many to a block, and the others alone."""
    if not apart:
        return [[p] for p in pieces]
    shown = [len(p) > 1 and p[1] in _FIRSTS and (p[-1] in _LASTS or p[-2] in _TWOS) for p in pieces]
    clean = [p for p, yes in zip(pieces, shown) if yes]
    blocks = [clean[i : i + BLOCK_PIECES] for i in range(0, len(clean), BLOCK_PIECES)]
    return blocks + [[p] for p, yes in zip(pieces, shown) if not yes]


class Pieces:
    """Alignments of pieces, which are remembered until they take ``limit`` bytes."""

    def __init__(self, tokens: Tokens, limit: int = MEMO_BYTES) -> None:
        self.tokens, self.limit = tokens, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        # Of each piece: A tokens, B tokens, groups, links, and where its links begin.
        self.sizes = np.zeros((5, 0), np.int64)
        self.pairs = np.zeros(0, np.uint32)
        self.held = 0

    def look_up(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces; each is a blank and more."""
        if self.held > self.limit:
            self.forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            blocks = in_blocks(new, self.tokens.apart)
            new = [p for block in blocks for p in block]
            found = Aligned(self.tokens, self.tokens.encode(blocks))
            groups = found.group_texts()
            begin = len(self.pairs) + np.cumsum(found.n_links) - found.n_links
            sizes = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links, begin])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.groups += groups
            self.sizes, self.pairs = np.hstack([self.sizes, sizes]), np.concatenate([self.pairs, found.pair])
            self.held += sum(map(len, new)) + sum(map(len, groups)) + found.pair.nbytes + PIECE_BYTES * len(new)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))


class Documents:
    """Links, groups and token counts of texts, from those of their pieces."""

    def __init__(self, pieces: Pieces, texts: list[str]) -> None:
        spaced = [b" " + t.encode() for t in texts]
        filled = np.flatnonzero([len(t) > 1 for t in spaced])
        spaced = [spaced[i] for i in filled.tolist()]
        ends = np.cumsum([len(t) for t in spaced], dtype=np.int64)
        starts = ends - np.array([len(t) for t in spaced], np.int64)
        data = b"".join(spaced)
        cuts = piece_starts(np.frombuffer(data, np.uint8), starts, pieces.tokens.apart)
        at = [*cuts.tolist(), len(data)]
        which = pieces.look_up([data[a:b] for a, b in zip(at, at[1:])])
        owner = filled[np.searchsorted(starts, cuts, side="right") - 1]
        # A text that a tokenizer does not give back has a piece without tokens, and none itself.
        whole = np.ones(len(texts), bool)
        whole[owner[pieces.sizes[0, which] == 0]] = False
        which, owner = which[whole[owner]], owner[whole[owner]]
        sizes = pieces.sizes[:, which]
        self.n_a, self.n_b, self.n_groups, self.n_links = (
            np.bincount(owner, n, len(texts)).astype(np.int64) for n in sizes[:4]
        )
        links, begin = sizes[3], sizes[4]
        place = np.repeat(begin - (np.cumsum(links) - links), links) + np.arange(links.sum())
        self.pair, self.doc = pieces.pairs[place], np.repeat(owner, links)
        groups = list(map(pieces.groups.__getitem__, which.tolist()))
        first = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        self.digests = [
            hashlib.sha256(b";".join(groups[a:b])).hexdigest() if b > a else "" for a, b in zip(first, first[1:])
        ]


_pieces: dict[tuple[bytes, bytes], Pieces] = {}


def _both(files: tuple[bytes, bytes]) -> Pieces:
    """Pieces by the tokenizers of two files; a worker keeps them from task to task."""
    if files not in _pieces:
        _pieces.clear()
        _pieces[files] = Pieces(Tokens(*files))
    return _pieces[files]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one zstd frame, each with its type and length."""
    parts = [struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) + a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sq", data, at)
        at += 10
        array = np.frombuffer(data, "<" + kind.decode(), n, at)
        at += array.nbytes
        out.append(array)
    return out


def small(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest unsigned type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def radix_of(pair: np.ndarray, radix: int) -> np.ndarray:
    """Part of a pair; it depends on the B id alone."""
    return ((pair >> np.uint32(16)) * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(radix)


class Runs:
    """A buffer of links that is spilled as sorted runs, one for each part."""

    def __init__(self, radix: int, limit: int) -> None:
        self.radix, self.limit = radix, limit
        self.held: list[np.ndarray] = []
        self.size, self.base = 0, 0

    def add(self, pair: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
        """Takes links of rows in ascending order; gives ``(base, part, directory, documents)``."""
        at = 0
        while at < len(pair):
            if not self.held:
                self.base = int(row[at])
            end = min(len(pair), at + self.limit - self.size, int(np.searchsorted(row, self.base + RUN_DOCS)))
            if end > at:
                doc = (row[at:end] - self.base).astype(np.uint64)
                self.held.append(pair[at:end].astype(np.uint64) << np.uint64(32) | doc)
                self.size += end - at
            at = end
            if at < len(pair) or self.size >= self.limit:
                yield from self.spill()

    def spill(self) -> Iterator[tuple]:
        if not self.held:
            return
        record, times = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        pair = (record >> np.uint64(32)).astype(np.uint32)
        part = radix_of(pair, self.radix)
        for p in range(self.radix):
            mine = np.flatnonzero(part == p)
            if len(mine) == 0:
                continue
            first = np.flatnonzero(np.diff(pair[mine], prepend=np.uint32(0xFFFFFFFF) - pair[mine[:1]]))
            docs = (record[mine] & np.uint64(0xFFFF)).astype(np.uint16)
            pairs, some = pair[mine][first], times[mine]
            directory = pack(
                np.diff(pairs, prepend=np.uint32(0)), small(np.add.reduceat(some, first)),
                small(np.diff(np.append(first, len(mine)))),
            )
            yield self.base, p, directory, pack(np.diff(docs, prepend=np.uint16(0)), small(some))


def directory(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs of a run, their links and their records."""
    gaps, links, records = unpack(blob)
    return np.cumsum(gaps, dtype=np.uint32), links.astype(np.int64), records.astype(np.int64)


def merged_counts(blobs: list[bytes], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted pairs and their links over all runs, by a k-way merge of blocks.

    The heap's least entry is the end of the block that ends first: up to there every run's
    entries are at hand.
    """
    runs = [directory(blob)[:2] for blob in blobs]
    at = [0] * len(runs)
    ends = [(int(pairs[min(block, len(pairs)) - 1]), i) for i, (pairs, _) in enumerate(runs)]
    heapq.heapify(ends)
    while ends:
        limit, _ = ends[0]
        keys, sums = [], []
        for i, (pairs, links) in enumerate(runs):
            stop = at[i] + int(np.searchsorted(pairs[at[i] : at[i] + block], limit, side="right"))
            keys.append(pairs[at[i] : stop])
            sums.append(links[at[i] : stop])
            at[i] = stop
        while ends and ends[0][0] <= limit:
            _, i = heapq.heappop(ends)
            pairs = runs[i][0]
            if at[i] < len(pairs):
                heapq.heappush(ends, (int(pairs[min(at[i] + block, len(pairs)) - 1]), i))
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, np.concatenate(sums))
        yield found, total


DOC, RUN = 0, 1


def encode_documents(docs: DataFrame, files, id_col: str, text_col: str, radix: int, run_links: int) -> DataFrame:
    """A stage table of documents (kind ``DOC``) and runs (kind ``RUN``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = (
        f"kind int, row long, `{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long,"
        " groups_sha256 string, part int, directory binary, documents binary"
    )
    names = ["kind", "row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "part", "directory", "documents"]

    def runs_batch(runs: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        base, part, directories, documents = zip(*runs)
        n = len(runs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([RUN] * n, pa.int32()), pa.array(base, pa.int64()), pa.nulls(n, id_type),
                *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string()), pa.array(part, pa.int32()),
                pa.array(directories, pa.binary()), pa.array(documents, pa.binary()),
            ],
            names=names,
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, spilled = _both(files.value), Runs(radix, run_links)
        row = TaskContext.get().partitionId() << 33
        id_type = None
        for batch in batches:
            for part in chunks(batch, text_col, CHUNK):
                aligned = Documents(pieces, [t or "" for t in part.column(text_col).to_pylist()])
                n, id_type = part.num_rows, part.column(id_col).type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([DOC] * n, pa.int32()), pa.array(row + np.arange(n)), part.column(id_col),
                        pa.array(aligned.n_a), pa.array(aligned.n_b), pa.array(aligned.n_groups), pa.array(aligned.n_links),
                        pa.array(aligned.digests, pa.string()), pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
                runs = list(spilled.add(aligned.pair, row + aligned.doc))
                if runs:
                    yield runs_batch(runs, id_type)
                row += n
        runs = list(spilled.spill())
        if runs:
            yield runs_batch(runs, id_type)

    return stage_table(docs.select(id_col, text_col).mapInArrow(kernel, ddl), "align-encoded")


def pair_counts(runs: DataFrame) -> DataFrame:
    """``part, pair, n, best``: links of every pair of ids; is it the largest of its B id?"""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(part: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            for pairs, n in merged_counts(blobs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), part, np.int32)), pa.array(pairs.astype(np.int64)), pa.array(n)],
                    names=["part", "pair", "n"],
                )

        key, held = None, []
        for batch in batches:
            for part, split, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "split", "directory"))):
                # A split has about RUNS_PER_SPLIT runs; more of them are merged in several turns.
                if held and (key != (part, split) or len(held) >= 4 * RUNS_PER_SPLIT):
                    yield from merged(key[0], held)
                    held = []
                key = part, split
                held.append(blob)
        if held:
            yield from merged(key[0], held)

    dealt = runs.select("part", "split", "directory").repartition("part", "split").sortWithinPartitions("part", "split")
    sums = dealt.mapInArrow(kernel, "part int, pair long, n long").groupBy("part", "pair").agg(F.sum("n").alias("n"))
    # A B id has at most as many pairs as the A side has ids.
    of_b = Window.partitionBy("part", F.shiftright("pair", 16))
    return stage_table(sums.withColumn("best", F.col("n") == F.max("n").over(of_b)), "align-counts")


def packed_counts(counts: DataFrame) -> DataFrame:
    """``part, first, counts``: blocks of sorted pairs, their counts and marks in one zstd frame."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            starts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1)) if len(part) else np.zeros(0, int)
            for a, b in zip(starts, [*starts[1:], len(part)]):
                some = batch.slice(a, b - a)
                pair, n = some.column("pair").to_numpy(), some.column("n").to_numpy()
                best = some.column("best").to_numpy(zero_copy_only=False)
                for at in range(0, len(pair), COUNTS_PER_BLOCK):
                    cut = slice(at, at + COUNTS_PER_BLOCK)
                    blob = pack(pair[cut].astype(np.uint32), small(n[cut]), best[cut].astype(np.uint8))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[a : a + 1]), pa.array(pair[cut][:1]), pa.array([blob], pa.binary())],
                        names=["part", "first", "counts"],
                    )

    ordered = counts.repartition("part").sortWithinPartitions("part", "pair")
    return stage_table(ordered.mapInArrow(kernel, "part int, first long, counts binary"), "align-packed")


def contributions(runs: DataFrame, counts: DataFrame, splits: int) -> DataFrame:
    """``row, n_best, count_sum``: what each run adds to its documents."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, table = None, [], None
        for batch in batches:
            columns = ("part", "split", "counts", "row", "directory", "documents")
            for part, split, block, row, pairs_of, documents in zip(*(batch.column(c).to_pylist() for c in columns)):
                if key != (part, split):
                    key, blocks, table = (part, split), [], None
                # A part's counts come before its runs.
                if block is not None:
                    blocks.append(unpack(block))
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*blocks)]
                    blocks = []
                pairs, _, records = directory(pairs_of)
                at = np.searchsorted(table[0], pairs)
                gaps, times = unpack(documents)
                doc, times = np.cumsum(gaps, dtype=np.uint16), times.astype(np.int64)
                n = np.repeat(table[1][at].astype(np.int64), records) * times
                best = np.repeat(table[2][at].astype(np.int64), records) * times
                order = np.argsort(doc, kind="stable")
                first = np.flatnonzero(np.diff(doc[order].astype(np.int64), prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + doc[order][first].astype(np.int64)),
                        pa.array(np.add.reduceat(best[order], first)),
                        pa.array(np.add.reduceat(n[order], first)),
                    ],
                    names=["row", "n_best", "count_sum"],
                )

    empty = F.lit(None).cast("binary")
    sent = counts.select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "first", "counts",
        F.lit(None).cast("long").alias("row"), empty.alias("directory"), empty.alias("documents"),
    )
    streamed = runs.select(
        "part", "split", F.lit(None).cast("long").alias("first"), empty.alias("counts"), "row", "directory", "documents"
    )
    dealt = sent.unionByName(streamed).repartition("part", "split")
    dealt = dealt.sortWithinPartitions("part", "split", F.col("first").asc_nulls_last(), "row")
    added = dealt.mapInArrow(kernel, "row long, n_best long, count_sum long")
    return added.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    radix: int = RADIX,
    run_links: int = RUN_LINKS,
    runs_per_split: int = RUNS_PER_SPLIT,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the corpus-wide counts of linked ids.

    The counts have ``a_id, b_id, n, best``; ``best`` marks the largest of each B id, ties included.
    """
    spark = docs.sparkSession
    ship_package(spark)
    contents = tuple(pathlib.Path(p).read_bytes() for p in (a_path, b_path))
    if max(map(len, contents)) > MAX_FILE_BYTES:
        raise ValueError("a tokenizer's file must be small enough to broadcast")
    files = spark.sparkContext.broadcast(contents)
    made = encode_documents(docs, files, id_col, text_col, radix, run_links)
    runs = made.filter(F.col("kind") == RUN)
    spills = runs.filter("part = 0").count()
    splits = max(1, -(-spills // runs_per_split))
    runs = runs.withColumn("split", F.pmod(F.xxhash64("row"), F.lit(splits)).cast("int"))
    counts = pair_counts(runs)
    added = contributions(runs, packed_counts(counts), splits)
    columns = [id_col, "n_a", "n_b", "n_groups", "n_links"]
    found = made.filter(F.col("kind") == DOC).select("row", *columns, "groups_sha256").join(added, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    ids = [F.col("pair").bitwiseAND(0xFFFF).alias("a_id"), F.shiftright("pair", 16).alias("b_id")]
    return found.select(*columns, *zero, "groups_sha256"), counts.select(*ids, "n", "best")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment(docs, *paths)[0]
