"""The prefix trie against its SQL twin, in one tree and in many."""

import random

import compare
import duckdb
import pytest

from vecprune.llm import trie

# Columns that the operator does not read and names that it uses.
EXTRA = "bundle long, place string, words string, ids long, n long, depth string, print string"


def rows():
    rng = random.Random(1)
    texts = ["a b", "c", "", "d  e f", None, "g h\ti"]
    out = []
    for c in [None, *range(-45, 160)]:
        if rng.random() < 0.15:
            continue
        for k in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            turn = rng.choice([None, k, k, k, 1])
            out.append((c, turn, rng.choice(["u", "u", "u", None]), rng.choice(texts[: rng.choice([1, 2, 6])])))
    # Long conversations that share much, and copies.
    out += [(c, i, "u", "a b") for c, n in ((40, 60), (60, 60), (80, 50)) for i in range(n)]
    out += [(c, 0, "u", "same") for c in range(1000, 1300)]
    return [(*r, 1, "p", "w", 2, 3, "d", "x") for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trie"))
    schema = f"conv_id long, turn long, role string, text string, {EXTRA}"
    spark.createDataFrame(rows(), schema).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


def test_query(spark, folder, con):
    assert compare.differences(trie.op11_trie(spark, folder), con, trie.OP11_SQL) == []


@pytest.mark.parametrize("segment, bundle", [(10, 8192), (25, 7), (8192, 1)])
def test_segments_and_bundles(spark, folder, con, segment, bundle):
    turns, without = trie.rebuilt(trie.turn_table(spark.read.parquet(f"{folder}/conversations.parquet")))
    nodes = trie.prefix_trie(turns, without, segment, bundle)
    assert compare.differences(nodes, con, trie.OP11_SQL) == []


def test_balanced_tree():
    assert sorted(trie.medians(11)) == list(range(11))
    tree = trie.Tree()
    for i in trie.medians(1023):
        tree.insert([i], [0])

    def height(at):
        return 1 + max(height(tree.low[at]), height(tree.high[at])) if at else 0

    assert height(tree.equal[0]) == 10
