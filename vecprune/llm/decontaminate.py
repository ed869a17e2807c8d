"""Benchmark decontamination by the q-gram lemma in overlapping diagonal bands.

A document is caught if it holds an item of at most ``PASSAGE`` characters, or any passage of so
many characters of a longer item, wherever in the item it stands.  For this, pieces of ``PIECE``
characters stand every ``STRIDE`` characters: each passage holds a whole piece, and the passages
around a piece that is found are verified one by one.  Items that are little longer are also
looked for as a whole, with the edits that their length allows.  If a piece of ``m`` characters occurs with at most ``k`` edits, at least
``m + 1 - q - k * q`` of its q-grams occur in the document on at most ``k + 1`` neighbouring
diagonals (document position minus piece position).  So shared q-grams are counted in bands of
diagonals that overlap by ``k``; bands that reach the bound are retained and verified by an
alignment within the band.

Texts and items are compared in lower case with every run of white space as one space.  A piece
or passage that many items share is looked for and aligned once; who has it follows from lists.
The pieces travel in a broadcast of the different item texts, at most ``PART_CHARS`` characters or
one text; a larger benchmark is taken in parts, one pass each.  Documents are not shuffled.

Defined results: NULL or empty texts hold nothing, and NULL or empty items are not looked for; an
item of fewer than ``Q`` characters is held if it stands there exactly, with no letter or digit
beside it; repeated rows are searched one by one and equal items are each reported; an empty table
on either side gives no hits; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.llm.simhash import free_name
from vecprune.llm.text import chunks, mix, prefix_hash, span_hash
from vecprune.session import ship_package
from vecprune.staging import stage_table

Q = 12
EDIT_PERCENT = 5
PASSAGE, STRIDE = 100, 10
PIECE = PASSAGE - STRIDE + 1
WHOLE = 150
BAND = 16
PART_CHARS = 8 << 20
BUCKETS = 4096
_TABLE_BITS = 22
_BLOCK_ROWS = 1 << 18
_NONE = np.iinfo(np.int64).max
_BREAK = "\n"


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def qgrams(chars: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place, doubling the length as far as ``Q`` allows."""
    base, hashes, length = np.uint64(0x9E3779B97F4A7C15), chars.astype(np.uint64) + np.uint64(1), 1
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        parts, done, power = None, 0, base
        while done < Q:
            if Q & length:
                piece = hashes[done : done + len(chars) - Q + 1]
                parts = piece if parts is None else parts * power + piece
                done += length
            if done < Q:
                hashes = hashes[:-length] * power + hashes[length:]
                power = power * power
                length *= 2
    return mix(parts)


def spread(first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the picked lists, where list ``i`` is ``first[i]`` to ``first[i + 1]``, and
    which pick each belongs to."""
    n = first[pick + 1] - first[pick]
    of = np.repeat(np.arange(len(pick)), n)
    return of, np.repeat(first[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())


def blocks(n: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive rows whose numbers ``n`` add up to about a block."""
    part = np.cumsum(n) // _BLOCK_ROWS
    yield from np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1)


def leaders(chars: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For each span the first span of its kind with the same characters."""
    prefix = prefix_hash(mix(chars.astype(np.uint64) + np.uint64(1)))
    key = mix(span_hash(prefix, start, start + size) + kind.astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    leader = first[which]
    copies = np.flatnonzero(leader != np.arange(len(leader)))
    column = np.arange(size.max(initial=0))
    for at in range(0, len(copies), 1 << 14):
        mine = copies[at : at + (1 << 14)]
        lead = leader[mine]
        place = np.stack([start[mine], start[lead]])[..., None] + column
        one, other = chars[np.minimum(place, len(chars) - 1)]
        same = ((one == other) | (column >= size[mine][:, None])).all(axis=1)
        same &= (size[mine] == size[lead]) & (kind[mine] == kind[lead])
        leader[mine[~same]] = mine[~same]
    return leader


def listed(group: np.ndarray, n: int) -> np.ndarray:
    """Where the list of each of ``n`` groups begins, the rows being in the order of the groups."""
    return np.searchsorted(group, np.arange(n + 1))


@dataclass
class Grams:
    """The places of every q-gram in some of the pieces."""

    piece: np.ndarray  # numbers of the pieces, in order
    grams: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # of the places of each distinct hash
    place: np.ndarray


@dataclass
class Pieces:
    """Different pieces of items, the items that hold them, and the places of their q-grams.

    A piece is a span of the items' joined characters, where it stands first.  Its holders are the
    places in items where it stands; a holder has passages around it, as numbers of the piece's
    different passages.  A piece without passages is a whole item.
    """

    chars: np.ndarray  # of all items
    start: np.ndarray  # of each piece; starts and ends are both in order
    size: np.ndarray
    edits: np.ndarray
    item: np.ndarray  # of each holder, in the order of the pieces; those of short items follow
    holders: np.ndarray  # first holder of each piece
    passages: np.ndarray  # first entry of each holder in ``passage``
    passage: np.ndarray
    around: np.ndarray  # first of each piece's different passages, those of most holders first
    begin: np.ndarray  # of each different passage
    moved: np.ndarray  # that place after the beginning of the piece
    shared: np.ndarray  # do several holders have it?
    grams: list[Grams]  # of pieces with several holders, and of those with one
    short: dict[int, tuple[np.ndarray, list[str], np.ndarray]]  # by length: hashes, texts, first holder

    @property
    def bound(self) -> np.ndarray:
        return self.size + 1 - Q - self.edits * Q


def cut(items: list[tuple[int, str | None]]) -> Pieces | None:
    texts, places, rows, begin = [], [], [], 0
    short: dict[str, list[int]] = {}
    for n, (_, text) in enumerate(items):
        text = normalised(text)
        size = len(text)
        if size < Q:
            if text:
                short.setdefault(text, []).append(n)
            continue
        if size > PASSAGE:
            for at in sorted({*range(0, size - PIECE + 1, STRIDE), size - PIECE}):
                reach = begin + max(0, at + PIECE - PASSAGE), begin + min(at, size - PASSAGE)
                rows.append((n, begin + at, PIECE, PASSAGE * EDIT_PERCENT // 100, *reach))
            texts.append(text)
            places.append(begin + np.arange(size - Q + 1))
            begin += size
        if size <= WHOLE:
            edits = min(size * EDIT_PERCENT // 100, (size - Q) // Q)
            # No passages: the piece itself is what is looked for.
            rows.append((n, begin, size, edits, 0, -1))
            texts.append(text)
            places.append(begin + np.arange(size - Q + 1))
            begin += size
    if not rows and not short:
        return None
    item, start, size, edits, low, high = np.array(rows, np.int64).reshape(-1, 6).T.copy()
    chars = codes("".join(texts))
    leader = leaders(chars, start, size, (high < low).astype(np.int64))
    lead = np.unique(leader)
    # Holders in the order of their pieces.
    piece = np.searchsorted(lead, leader)
    order = np.argsort(piece, kind="stable")
    piece, item, low, high, own = piece[order], item[order], low[order], high[order], start[order]
    # The passages of each holder, and the different ones of each piece.
    n = high - low + 1
    holder = np.repeat(np.arange(len(n)), n)
    passage = low[holder] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    stands = np.unique(passage)
    same = stands[leaders(chars, stands, np.full(len(stands), PASSAGE), np.zeros(len(stands), np.int64))]
    key = (piece[holder] * STRIDE + own[holder] - passage) * max(len(chars), 1) + same[np.searchsorted(stands, passage)]
    different, which, count = np.unique(key, return_inverse=True, return_counts=True)
    of, moved = np.divmod(different // max(len(chars), 1), STRIDE)
    common = np.lexsort((-count, of))
    number = np.empty_like(common)
    number[common] = np.arange(len(common))
    holders = listed(piece, len(lead))
    place = np.concatenate([*places, np.zeros(0, np.int64)])
    hashes = np.concatenate([*(qgrams(codes(t)) for t in texts), np.zeros(0, np.uint64)])
    several = np.diff(holders) > 1
    grams = [
        _grams(np.flatnonzero(chosen), start[lead], size[lead], place, hashes)
        for chosen in (several, ~several)
        if chosen.any()
    ]
    found, at = {}, len(item)
    for length in sorted({len(t) for t in short}):
        group = sorted(t for t in short if len(t) == length)
        joined = codes("".join(group))
        begins = np.arange(len(group)) * length
        hashes = span_hash(prefix_hash(joined.astype(np.uint64) + np.uint64(1)), begins, begins + length)
        by_hash = np.argsort(hashes, kind="stable")
        group = [group[i] for i in by_hash]
        ends = at + np.cumsum([0, *(len(short[t]) for t in group)])
        found[length] = hashes[by_hash], group, ends
        item, at = np.concatenate([item, *(np.array(short[t], np.int64) for t in group)]), int(ends[-1])
    return Pieces(
        chars=chars,
        start=start[lead],
        size=size[lead],
        edits=edits[lead],
        item=item,
        holders=holders,
        passages=np.concatenate([[0], np.cumsum(n)]),
        passage=number[which],
        around=listed(of[common], len(lead)),
        begin=(different % max(len(chars), 1))[common],
        moved=-moved[common],
        shared=count[common] > 1,
        grams=grams,
        short=found,
    )


def _grams(piece: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> Grams:
    """The q-grams of these places that lie within the pieces."""
    edge = np.bincount(start[piece], minlength=place.max() + Q + 1)
    edge -= np.bincount(start[piece] + size[piece] - Q + 1, minlength=len(edge))
    inside = np.cumsum(edge)[place] > 0
    place, hashes = place[inside], hashes[inside]
    order = np.argsort(hashes, kind="stable")
    distinct, first = np.unique(hashes[order], return_index=True)
    return Grams(piece, distinct, np.append(first, len(hashes)), place[order])


class Search:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.mask = np.zeros(1 << _TABLE_BITS, bool)
        for known in pieces.grams:
            self.mask[known.grams >> np.uint64(64 - _TABLE_BITS)] = True
        self.slack = int(pieces.edits.max(initial=0))
        self.least = int(pieces.bound.min(initial=1 << 30))
        self.reach = int(pieces.size.max(initial=0)) + self.slack

    def _marked(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram may be one of a piece, and its hashes."""
        hashes = qgrams(joined)
        at = np.flatnonzero(self.mask[hashes >> np.uint64(64 - _TABLE_BITS)])
        return at, hashes[at]

    def _find(self, known: Grams, at, hashes, joined, begin, size) -> tuple[np.ndarray, ...]:
        """Text, piece, edits and diagonal of every piece found."""
        gram = np.minimum(np.searchsorted(known.grams, hashes), len(known.grams) - 1)
        real = known.grams[gram] == hashes
        at, gram = at[real], gram[real]
        # A place matters only if enough hits lie within reach on either side.
        right = np.searchsorted(at, at + self.reach, side="right")
        enough = np.flatnonzero(right - np.arange(len(at)) >= self.least)
        near = np.zeros(len(at) + 1, np.int64)
        np.add.at(near, enough, 1)
        np.add.at(near, right[enough], -1)
        keep = np.cumsum(near[:-1]) > 0
        at, gram = at[keep], gram[keep]
        # Places further apart than the reach share no piece, so they can be taken in turn.
        runs = np.flatnonzero(np.diff(at, prepend=-2 * self.reach - 1) > self.reach)
        found = [(np.zeros(0, np.int64),) * 4]
        if len(at):
            places = np.add.reduceat(known.first[gram + 1] - known.first[gram], runs)
            ends = np.append(runs, len(at))
            for some in blocks(places):
                rows = slice(ends[some[0]], ends[some[-1] + 1])
                found.append(self._count(known, at[rows], gram[rows], joined, begin, size))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _count(self, known: Grams, at, gram, joined, begin, size) -> tuple[np.ndarray, ...]:
        """The pieces whose q-grams reach the bound within a band, and whose alignment does."""
        p = self.pieces
        # All places of each q-gram in the pieces.
        source, posting = spread(known.first, gram)
        at, place = at[source], known.place[posting]
        # The pieces around each place.
        start = p.start[known.piece]
        low = np.searchsorted(start + p.size[known.piece] - Q, place)
        n = np.searchsorted(start, place, side="right") - low
        source = np.repeat(np.arange(len(place)), n)
        piece = known.piece[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        diagonal = at[source] - (place[source] - p.start[piece])
        text = np.searchsorted(begin, at[source], side="right") - 1
        band = diagonal // BAND
        low = diagonal - band * BAND <= self.slack
        band = np.concatenate([band, band[low] - 1])
        text, piece = np.concatenate([text, text[low]]), np.concatenate([piece, piece[low]])
        if not len(text):
            return (np.zeros(0, np.int64),) * 4
        least, wide = band.min(), band.max() - band.min() + 1
        keys, count = np.unique((text * len(p.start) + piece) * wide + band - least, return_counts=True)
        band, keys = keys % wide + least, keys // wide
        text, piece = keys // len(p.start), keys % len(p.start)
        enough = count >= p.bound[piece]
        text, piece, band = text[enough], piece[enough], band[enough]
        edits = self._align(joined, begin[text], (begin + size)[text], p.start[piece], p.size[piece], band * BAND)
        good = edits <= p.edits[piece]
        return text[good], piece[good], edits[good], band[good] * BAND

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], np.int64)
        return codes(_BREAK.join(texts)), np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, holder, edits and place of every piece around which a passage of the holder is found."""
        p = self.pieces
        joined, begin, size = self._joined(texts)
        at, hashes = self._marked(joined)
        pieces = [(np.zeros(0, np.int64),) * 4]
        pieces += [self._find(known, at, hashes, joined, begin, size) for known in p.grams]
        text, piece, edits, diagonal = (np.concatenate(c) for c in zip(*pieces))
        found = [self._short(joined, begin)]
        for rows in blocks(STRIDE * (p.holders[piece + 1] - p.holders[piece])):
            of, holder = spread(p.holders, piece[rows])
            hit = rows[of]
            of, entry = spread(p.passages, holder)
            mine, passage = hit[of], p.passage[entry]
            least = np.where(p.passages[holder + 1] > p.passages[holder], _NONE, edits[hit])
            # No passage has fewer edits than its piece, so a holder that has as few is settled.
            for shared in (True, False):
                take = np.flatnonzero((p.shared[passage] == shared) & (least[of] > edits[mine]))
                units, which = np.unique(mine[take] * len(p.begin) + passage[take], return_inverse=True)
                if len(units):
                    n, number = np.divmod(units, len(p.begin))
                    value = self._passage(joined, begin, size, text[n], number, diagonal[n])
                    np.minimum.at(least, of[take], value[which])
            good = least <= p.edits[piece[hit]]
            hit, holder = hit[good], holder[good]
            found.append((text[hit], holder, least[good], diagonal[hit] - begin[text[hit]]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def contaminated(self, texts: list[str]) -> np.ndarray:
        """Does each text hold any item or passage?

        Pieces that several items share come first; a text is settled by the first passage found.
        """
        joined, begin, size = self._joined(texts)
        at, hashes = self._marked(joined)
        text = np.searchsorted(begin, at, side="right") - 1
        out = np.zeros(len(texts), bool)
        out[self._short(joined, begin)[0]] = True
        for known in self.pieces.grams:
            rows = ~out[text]
            self._settle(out, joined, begin, size, *self._find(known, at[rows], hashes[rows], joined, begin, size))
        return out

    def _settle(self, out: np.ndarray, joined, begin, size, text, piece, _, diagonal) -> None:
        """Mark the texts with a passage around one of the pieces found."""
        p = self.pieces
        count = p.around[piece + 1] - p.around[piece]
        out[text[count == 0]] = True
        done, step = 0, 4
        # At first one piece of each text, which settles most that hold a passage.
        rest = np.flatnonzero(~out[text])
        rest = rest[np.unique(text[rest], return_index=True)[1]]
        first = True
        while len(rest):
            for rows in blocks(np.minimum(count[rest] - done, step)):
                hit = rest[rows]
                hit = hit[~out[text[hit]]]
                n = np.minimum(count[hit] - done, step)
                of = np.repeat(hit, n)
                number = p.around[piece[of]] + done + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                value = self._passage(joined, begin, size, text[of], number, diagonal[of])
                out[text[of[value <= p.edits[piece[of]]]]] = True
            # Then the next passages of every piece in a text that is still open.
            done, step, first = (0, 4, False) if first else (done + step, 4 * step, False)
            rest = np.flatnonzero(~out[text] & (count > done))

    def _passage(self, joined, begin, size, text, number, diagonal) -> np.ndarray:
        """Least edits of the numbered passages; the diagonals are those of their pieces."""
        p = self.pieces
        length = np.full(len(text), PASSAGE)
        return self._align(
            joined, begin[text], (begin + size)[text], p.begin[number], length, diagonal + p.moved[number]
        )

    def _short(self, joined: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, holder, edits and place of the short items, with no letter or digit beside them."""
        found = [(np.zeros(0, np.int64),) * 4]
        if self.pieces.short and len(joined):
            values, which = np.unique(joined, return_inverse=True)
            letter = np.array([chr(c).isalnum() for c in values])[which]
            before, after = np.append(False, letter), np.append(letter, False)
            prefix = prefix_hash(joined.astype(np.uint64) + np.uint64(1))
        for length, (hashes, group, first) in self.pieces.short.items():
            at = np.arange(max(len(joined) - length + 1, 0))
            at = at[~before[at] & ~after[at + length]] if len(at) else at
            if not len(at):
                continue
            key = span_hash(prefix, at, at + length)
            spot = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            at, spot = at[hashes[spot] == key], spot[hashes[spot] == key]
            wanted = codes("".join(group)).reshape(-1, length)
            same = (joined[at[:, None] + np.arange(length)] == wanted[spot]).all(axis=1)
            at, spot = at[same], spot[same]
            text = np.searchsorted(begin, at, side="right") - 1
            # The first place in each text will do.
            _, one = np.unique(text * len(group) + spot, return_index=True)
            of, holder = spread(first, spot[one])
            text, place = text[one][of], (at - begin[text])[one][of]
            found.append((text, holder, np.zeros(len(text), np.int64), place))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _align(self, joined, begin, end, start, length, diagonal, block: int = 2048) -> np.ndarray:
        """Least edits of each span of items within its band, free to begin and end in the text."""
        out = np.zeros(len(start), np.int64)
        width = BAND + 3 * self.slack + 1
        column = np.arange(width)
        items = self.pieces.chars
        for at in range(0, len(start), block):
            rows = slice(at, at + block)
            size, first = length[rows], start[rows]
            place = (diagonal[rows] - self.slack)[:, None] + column
            lo, hi = begin[rows][:, None], end[rows][:, None]
            cost = np.zeros(place.shape, np.int64)
            best = np.zeros(len(size), np.int64)
            for i in range(int(size.max(initial=0))):
                inside = (place + i >= lo) & (place + i < hi)
                text = np.where(inside, joined[np.clip(place + i, 0, len(joined) - 1)], 0x110001)
                # Beyond its end a span is aligned no further; what it reads there is not used.
                step = cost + (text != items[np.minimum(first + i, len(items) - 1)][:, None])
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                # Skipped text characters: a running minimum with one more edit per column.
                cost = np.minimum.accumulate(step - column, axis=1) + column
                ended = size == i + 1
                best[ended] = cost[ended].min(axis=1)
            out[rows] = best
        return out


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document row and item found in it.

    ``n_pieces`` counts the item's pieces (one every ``STRIDE`` characters) around which a passage
    was found, ``least_edits`` is the smallest
    number of edits, ``first_place`` about where the first of them begins in the normalised text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    number = free_name([id_col, item_col, "n_pieces", "least_edits", "first_place"], "number")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{number}` long, n_pieces long, least_edits long, first_place long"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("piece_text"))
    texts = _texts(items.select("piece_text"))
    found = []
    for numbers, search in _parts(texts):

        def kernel(batches: Iterator[pa.RecordBatch], numbers=numbers, search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text_col):
                    texts = [normalised(t) for t in part.column(text_col).to_pylist()]
                    text, holder, edits, place = search.value.hits(texts)
                    item = search.value.pieces.item[holder]
                    pairs, to = np.unique(np.stack([text, item]), axis=1, return_inverse=True)
                    seen = np.unique(np.stack([to, holder]), axis=1)[0]
                    least = np.full(pairs.shape[1], _NONE)
                    first = least.copy()
                    np.minimum.at(least, to, edits)
                    np.minimum.at(first, to, np.maximum(place, 0))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(id_col).take(pa.array(pairs[0], pa.int64())),
                            pa.array(numbers.value[pairs[1]]),
                            pa.array(np.bincount(seen, minlength=pairs.shape[1]).astype(np.int64)),
                            pa.array(least),
                            pa.array(first),
                        ],
                        names=[id_col, number, "n_pieces", "least_edits", "first_place"],
                    )

        found.append(docs.select(id_col, text_col).mapInArrow(kernel, schema))
    hits = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    # Equal items are found as one text and reported each.
    owners = items.join(texts, "piece_text").select(F.col("number").alias(number), F.col("item").alias(item_col))
    return hits.join(owners, number).select(id_col, item_col, "n_pieces", "least_edits", "first_place")


def _texts(texts: DataFrame) -> DataFrame:
    """The different texts (``piece_text``) with a number; a stage table."""
    different = texts.where("piece_text IS NOT NULL").distinct()
    return stage_table(different.withColumn("number", F.monotonically_increasing_id()), "item-texts")


def _parts(texts: DataFrame):
    """Broadcast numbers and searches of parts of the item texts that are small enough."""
    spark = texts.sparkSession
    bucket = F.pmod(F.xxhash64("piece_text"), F.lit(BUCKETS))
    sizes = texts.groupBy(bucket.alias("bucket")).agg(F.sum(F.length("piece_text")).alias("chars"))
    part, total, ends = 0, 0, {}
    for row in sorted(sizes.collect()):
        if total and total + row.chars > PART_CHARS:
            part, total = part + 1, 0
        total += row.chars
        low, _ = ends.get(part, (row.bucket, None))
        ends[part] = low, row.bucket
    for low, high in ends.values():
        rows = texts.where(bucket.between(low, high)).orderBy("piece_text").toArrow()
        pieces = cut(list(enumerate(rows.column("piece_text").to_pylist())))
        if pieces is not None:
            numbers = rows.column("number").to_numpy()
            yield spark.sparkContext.broadcast(numbers), spark.sparkContext.broadcast(Search(pieces))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text"
) -> DataFrame:
    """Documents in which no piece of the benchmark is found; all columns stay."""
    ship_package(docs.sparkSession)
    for _, search in _parts(_texts(benchmark.select(F.col(item_text_col).alias("piece_text")))):

        def kernel(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text_col):
                    texts = [normalised(t) for t in part.column(text_col).to_pylist()]
                    yield part.filter(pa.array(~search.value.contaminated(texts)))

        docs = docs.mapInArrow(kernel, docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return benchmark_hits(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
