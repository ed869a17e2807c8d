"""Prefix trie of conversations from ternary search trees over range shards.

*Turns.*  A turn is a role and a text, known by a 256-bit digest.  A dictionary gives each
different turn a number, and a conversation becomes the list of its turns' numbers.  Turns that
hold a large share of all rows are looked up in a small broadcast.

*Shards.*  The lists are range-partitioned by (list, conversation), so that copies of one
conversation spread over tasks too, and each sorted partition is cut in bundles of bounded
size.  A bundle becomes a ternary search tree, into which the median list goes first, then
the medians of both halves, and so on, so that the trees of every level are balanced.  Its
nodes are made before their descendants; one walk in the other direction adds up members,
children, leaves and savings.

*Boundaries.*  Only nodes on the way to the first or the last list of a bundle can continue in
another one.  These few rows go in order through one task, which keeps the nodes of the present
way open and closes a node when a bundle leaves it.  Where a parent closes later than its
child, the child looks the parent's conversation up by (bundle, place on the way).

*Long conversations.*  A list has at most ``SEGMENT`` numbers.  What is longer goes on in a
tree of its own below a digest of all that was before; deeper trees are counted first, and
their roots' sums enter the trees above them.

Defined results: rows with a NULL ``conv_id`` belong to no conversation and are left out; a NULL
role or text is an empty one; a NULL turn comes first; equal turn numbers go by the turn's
digest, so repeated rows are repeated turns; an empty table has no node; other columns play no
part.  A node's list of ending conversations is hashed as a stream, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecprune.llm.lookup import look_up
from vecprune.operators.ordinal import ordinal
from vecprune.session import ship_package
from vecprune.staging import stage_table

SEGMENT = 8192
# Lists in a bundle; it also ends with so many times as many turns.
BUNDLE, TURNS_PER_ROW = 8192, 16
WORD = r"[^\x20\x09-\x0D]+"


def turn_table(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id, words``: numbered turns with dictionary numbers for their content."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.unhex(F.sha2(content, 256)).alias("print"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    turns = stage_table(turns, "trie-turns")
    dictionary = turns.groupBy("print").agg(F.count("*").alias("n"))
    dictionary = stage_table(dictionary.withColumn("turn_id", F.monotonically_increasing_id()), "trie-dictionary")
    encoded = stage_table(look_up(turns, dictionary, "print", "n"), "trie-encoded")
    numbered = ordinal(encoded, [F.col("turn").asc_nulls_first(), F.col("print")], ["conv_id"])
    return stage_table(numbered.select("conv_id", "pos", "turn_id", "words"), "trie-numbered")


def rebuilt(turns: DataFrame, heads: int = 4, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and those conversations that have none.

    Conversation ``c`` starts with the first ``crc32(c) % heads`` turns of ``c - c % every``
    and goes on with its own turns after as many.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    conv = F.col("conv_id")
    taken = (F.crc32(conv.cast("string").cast("binary")) % heads).alias("taken")
    convs = stage_table(sizes.select("conv_id", "n", taken, (conv - conv % every).alias("base")), "trie-convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("taken", F.coalesce("base_n", F.lit(0)))
    length = F.col("head") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    convs = convs.join(bases, "base", "left").withColumn("head", head).withColumn("length", length)
    convs = stage_table(convs.select("conv_id", "n", "taken", "base", "head", "length"), "trie-rebuilt")

    own = look_up(turns, convs.drop("base"), "conv_id", "n").filter("pos > taken")
    own = own.select("conv_id", (F.col("head") + F.col("pos") - F.col("taken")).alias("depth"), "turn_id", "words", "length")
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    # A base has fewer than 2 * every conversations, and gives each a few turns.
    borrowed = first.join(convs.drop("n"), "base").filter("pos <= taken")
    borrowed = borrowed.select("conv_id", F.col("pos").alias("depth"), "turn_id", "words", "length")
    return own.unionByName(borrowed), convs.filter("length = 0").select("conv_id")


def segments(turns: DataFrame, without: DataFrame, size: int) -> tuple[DataFrame, int]:
    """A row per conversation and ``size`` turns, and the largest segment number.

    Columns: ``conv_id, segment, ids, words, ends``; the ids of a later segment start with two
    digests of the segments before.
    """
    segment = F.floor((F.col("depth") - 1) / size).cast("int")
    rows = turns.groupBy("conv_id", segment.alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "turn_id", "words"))).alias("t"),
        F.max("length").alias("length"),
    )
    # A conversation that ends with a segment is a member of the next tree's root too.
    after = (F.col("segment") + 1).cast("long") * size
    none = F.array().cast("array<long>")
    more = F.explode(F.when(F.col("length") == after, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("*", more.alias("more"))
    here = F.col("more") == 0
    rows = rows.select(
        "conv_id",
        (F.col("segment") + F.col("more")).alias("segment"),
        F.when(here, F.col("t.turn_id")).otherwise(none).alias("ids"),
        F.when(here, F.col("t.words")).otherwise(none).alias("words"),
        (here & (F.col("length") <= after)).alias("ends"),
    )
    empty = without.select(
        "conv_id", F.lit(0).alias("segment"), none.alias("ids"), none.alias("words"), F.lit(True).alias("ends")
    )
    rows = stage_table(rows.unionByName(empty), "trie-segments")
    last = rows.agg(F.max("segment")).first()[0] or 0
    if last == 0:
        return rows, 0
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.bit_xor(F.xxhash64(F.lit(seed), "segment", "ids")).over(before) for seed in (1, 2)]
    rows = rows.withColumn("keys", F.array(*keys))
    later = F.col("segment") > 0
    rows = rows.withColumn("ids", F.when(later, F.concat("keys", "ids")).otherwise(F.col("ids")))
    zeros = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("words", F.when(later, F.concat(zeros, "words")).otherwise(F.col("words")))
    return stage_table(rows.drop("keys"), "trie-keyed"), last


class Tree:
    """A ternary search tree over lists of numbers; node 0 is the empty list.

    A node stands for a list: ``symbol`` is its last number, ``up`` the list without it; ``low``
    and ``high`` lead to siblings, ``equal`` to the longer lists.
    """

    def __init__(self) -> None:
        self.symbol, self.low, self.high, self.equal = [0], [0], [0], [0]
        self.up, self.depth, self.words = [-1], [0], [0]

    def _new(self, symbol: int, up: int, words: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.low, 0), (self.high, 0), (self.equal, 0),
            (self.up, up), (self.depth, self.depth[up] + 1), (self.words, words),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int], words: list[int]) -> list[int]:
        """The nodes on the way to a list, which are made where there are none."""
        way = [0]
        for symbol, n in zip(ids, words):
            up = way[-1]
            at = self.equal[up]
            if not at:
                at = self.equal[up] = self._new(symbol, up, n)
            while self.symbol[at] != symbol:
                side = self.low if symbol < self.symbol[at] else self.high
                if not side[at]:
                    side[at] = self._new(symbol, up, n)
                at = side[at]
            way.append(at)
        return way


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, every stretch's median before its halves."""
    stretches = [(0, n)]
    while stretches:
        a, b = stretches.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stretches += [(middle + 1, b), (a, middle)]


class Bundle:
    """Sums of the tree of neighbouring sorted lists."""

    def __init__(self, rows: list[tuple]) -> None:
        """``rows`` of conversation, ids, words, ends and the sums of the trees below."""
        groups: list[list[tuple]] = []
        for row in rows:
            if groups and groups[-1][0][1] == row[1]:
                groups[-1].append(row)
            else:
                groups.append([row])
        tree = self.tree = Tree()
        end = {}
        for i in medians(len(groups)):
            way = tree.insert(groups[i][0][1], groups[i][0][2])
            end[way[-1]] = groups[i]
            if i == 0:
                self.first = way
            if i == len(groups) - 1:
                self.last = way
        n = len(tree.symbol)
        self.members, self.least = [0] * n, [None] * n
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        self.ends: dict[int, str] = {}
        for at, group in end.items():
            self.members[at] = len(group)
            self.least[at] = group[0][0]
            self.children[at] = sum(r[4] for r in group)
            self.leaves[at] = sum(r[5] for r in group)
            self.saved[at] = sum(r[6] for r in group)
            self.ends[at] = ",".join(str(r[0]) for r in group if r[3])
        common = sum(1 for a, b in zip(self.first, self.last) if a == b)
        # Rows of the way: the first list's nodes, then those only the last list has.
        self.way = self.first + self.last[common:]
        self.common = common
        self.place = {at: k for k, at in enumerate(self.way)}
        for at in range(n - 1, 0, -1):
            if at not in self.place:
                self.close(at)
            up = tree.up[at]
            self.members[up] += self.members[at]
            if self.least[up] is None or self.least[at] < self.least[up]:
                self.least[up] = self.least[at]
            if at not in self.place:
                self.children[up] += 1
                self.leaves[up] += self.leaves[at]
                self.saved[up] += self.saved[at]

    def close(self, at: int) -> None:
        self.saved[at] += (self.members[at] - 1) * self.tree.words[at]
        if not self.children[at]:
            self.leaves[at] = 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


NODE = [
    ("kind", pa.int32()), ("bundle", pa.int64()), ("place", pa.int32()), ("up_place", pa.int32()),
    ("depth", pa.int32()), ("symbol", pa.int64()), ("words", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
]
NODE_SCHEMA = pa.schema(NODE)
NODE_DDL = (
    "kind int, bundle long, place int, up_place int, depth int, symbol long, words long, conv_id long,"
    " parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
# A finished node, a node on a bundle's way, and the conversation of such a place.
DONE, OPEN, PLACE = 0, 1, 2


def bundle_rows(bundle: int, rows: list[tuple]) -> pa.RecordBatch:
    """Finished nodes of a bundle and the open ones on its way.

    ``up_place`` is the parent's place if the parent is open.
    """
    b = Bundle(rows)
    t, out = b.tree, []
    for at in range(len(t.symbol)):
        k, up = b.place.get(at), t.up[at]
        ends = b.ends.get(at, "")
        out.append(
            (
                DONE if k is None else OPEN, bundle, k, b.place.get(up), t.depth[at], t.symbol[at], t.words[at],
                b.least[at], None if up < 0 or up in b.place else b.least[up], b.members[at], b.children[at],
                b.leaves[at], b.saved[at], sha(ends) if k is None else ends,
            )
        )
    return batch_of(out)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(NODE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA)], schema=NODE_SCHEMA)


def shard_nodes(limit: int):
    """A kernel that makes the nodes of a sorted partition's bundles, numbered in the order of the lists."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        turns = 0
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in batch.schema.names)):
                held.append(row)
                turns += len(row[1])
                if len(held) >= limit or turns >= limit * TURNS_PER_ROW:
                    yield bundle_rows(bundle, held)
                    bundle, held, turns = bundle + 1, [], 0
        if held:
            yield bundle_rows(bundle, held)

    return kernel


class OpenNode:
    __slots__ = ("depth", "symbol", "words", "least", "n", "children", "leaves", "saved", "sha", "any", "places", "up")

    def __init__(self, depth: int, symbol: int, words: int, up: tuple) -> None:
        self.depth, self.symbol, self.words, self.up = depth, symbol, words, up
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.any, self.places = hashlib.sha256(), False, []


def merge_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes and places from all open rows in the order of (bundle, place)."""
    way: list[OpenNode] = []
    out: list[tuple] = []

    def close(depth: int) -> None:
        while len(way) > depth:
            node = way.pop()
            node.saved += (node.n - 1) * node.words
            if not node.children:
                node.leaves = 1
            if way:
                way[-1].children += 1
                way[-1].leaves += node.leaves
                way[-1].saved += node.saved
            out.append(
                (
                    DONE, node.up[0], None, node.up[1], node.depth, node.symbol, node.words, node.least, None, node.n,
                    node.children, node.leaves, node.saved, node.sha.hexdigest(),
                )
            )
            for bundle, place in node.places:
                out.append((PLACE, bundle, place, *[None] * 4, node.least, *[None] * 6))

    for batch in batches:
        columns = ("bundle", "place", "up_place", "depth", "symbol", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
        for bundle, k, up, depth, symbol, words, least, n, children, leaves, saved, ends in zip(
            *(batch.column(c).to_pylist() for c in columns)
        ):
            # The first places lead down to the bundle's first list and may be known already.
            leads = up is None or k == up + 1 and k == depth
            if not (leads and len(way) > depth and way[depth].symbol == symbol):
                close(depth)
                way.append(OpenNode(depth, symbol, words, (bundle, up)))
            node = way[depth]
            node.least = least if node.least is None else min(node.least, least)
            node.n += n
            node.children += children
            node.leaves += leaves
            node.saved += saved
            node.places.append((bundle, k))
            if ends:
                node.sha.update(("," * node.any + ends).encode())
                node.any = True
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
    close(0)
    if out:
        yield batch_of(out)


def forest(rows: DataFrame, skip: int, bundle: int) -> DataFrame:
    """Nodes of the trees of ``rows``: lists of which the first ``skip`` numbers name the tree."""
    columns = ["conv_id", "ids", "words", "ends", "more_children", "more_leaves", "more_saved"]
    dealt = rows.select(columns).repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    made = stage_table(dealt.mapInArrow(shard_nodes(bundle), NODE_DDL), "trie-shards")
    # As many rows as bundles have nodes on their ways: two lists a bundle, not the data.
    ordered = made.filter(F.col("kind") == OPEN).repartition(1).sortWithinPartitions("bundle", "place")
    merged = stage_table(ordered.mapInArrow(merge_boundaries, NODE_DDL), "trie-merged")
    places = merged.filter(F.col("kind") == PLACE).select(
        "bundle", F.col("place").alias("up_place"), F.col("conv_id").alias("up_conv")
    )
    nodes = made.filter(F.col("kind") == DONE).unionByName(merged.filter(F.col("kind") == DONE))
    # A place has no more children than its bundle has nodes.
    nodes = nodes.join(places, ["bundle", "up_place"], "left")
    parent = F.when(F.col("depth") > skip, F.coalesce("parent_conv_id", "up_conv"))
    return nodes.filter(F.col("depth") >= skip).select(
        "conv_id",
        (F.col("depth") - skip).cast("long").alias("depth"),
        parent.alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )


def prefix_trie(
    turns: DataFrame, without: DataFrame, segment: int = SEGMENT, bundle: int = BUNDLE
) -> DataFrame:
    """A row per node of the trie over ``turns`` of ``conv_id, depth, turn_id, words, length``.

    ``without`` are the ids of conversations that have no turn.
    """
    ship_package(turns.sparkSession)
    rows, last = segments(turns, without, segment)
    below, found = None, []
    for number in range(last, -1, -1):
        some = rows.filter(F.col("segment") == number)
        if below is not None:
            some = some.join(below, "conv_id", "left")
        for name in ("more_children", "more_leaves", "more_saved"):
            value: Column = F.lit(0) if below is None else F.coalesce(name, F.lit(0))
            some = some.withColumn(name, value.cast("long"))
        if below is not None:
            some = stage_table(some, "trie-with-sums")
        nodes = forest(some, 2 if number else 0, bundle)
        if last:
            nodes = stage_table(nodes, "trie-nodes")
        below = nodes.filter("depth = 0").select(
            "conv_id",
            F.col("n_children").alias("more_children"),
            F.col("n_leaves").alias("more_leaves"),
            F.col("saved_tokens").alias("more_saved"),
        )
        kept = nodes.filter("depth > 0") if number else nodes
        found.append(kept.withColumn("depth", F.col("depth") + number * segment))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(*rebuilt(turns))


OP11_SQL = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))) AS tab
), turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1),
               lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
               lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 4 AS taken
    FROM (SELECT DISTINCT conv_id FROM turns), crc
), made AS (
    SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.taken
    UNION ALL
    SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.taken
), lists AS (
    SELECT c.conv_id, coalesce(l, []) AS l FROM convs c LEFT JOIN (
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS l FROM made GROUP BY conv_id) USING (conv_id)
), prefixes AS (
    SELECT conv_id, unnest(range(len(l) + 1)) AS depth, l FROM lists
), members AS (
    SELECT conv_id, depth, l[:depth] AS prefix, len(l) = depth AS ends FROM prefixes
), nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
           (count(*) - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) AS saving
    FROM members GROUP BY depth, prefix
), kids AS (
    SELECT depth - 1 AS depth, prefix[:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
    SELECT a AS depth, prefix[:a] AS prefix, sum(saving) AS saved, count(*) FILTER (leaf) AS leaves
    FROM (SELECT n.prefix, coalesce(n.saving, 0) AS saving, k.n IS NULL AS leaf, unnest(range(n.depth + 1)) AS a
          FROM nodes n LEFT JOIN kids k USING (depth, prefix)) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (depth, prefix) LEFT JOIN kids k USING (depth, prefix)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]
"""
