"""Quotes of some lines or paragraphs of a message."""

import random

import duckdb
from pyspark.sql import functions as F

import compare
from vecprune.llm import quotes

MESSAGES = [
    (1, 0, "user", "l1\nl2\nl3\nl4"),
    (1, 1, "assistant", "> l2\n> l3\nyes"),
    (1, 2, "user", "> l2\n> l4\nlines that do not follow each other"),
    (2, 0, "user", "a one\na two\n\nb\n\nc"),
    (2, 1, "user", "a one\na two\n\nb\n\nc"),
    (2, 2, "assistant", "> A  one\n> a two\n>\n> b\ntwo of three paragraphs, first said by 0"),
    (3, 0, "user", "q1\n\nq2"),
    (3, 1, "assistant", "> q1\nb1\nb2\n> q2\nb3\nb4"),
    (3, 2, "user", ">> q1\n> b1\n> b2\n>> q2\n> b3\n> b4\nquoted whole"),
    (4, 0, "user", "> l2\n> l3\nnot said before"),
    (4, 1, "user", "l2\nl3\nl4"),
    (4, 2, "user", "> x\n> l3\n> l4"),
]


def test_lines_that_follow_each_other(spark):
    messages = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn) for r in quotes.link_quotes(messages).collect()}
    assert found[1, 1] == (1, 1, 0)
    assert found[1, 2] == (1, 0, None)
    assert found[2, 2] == (1, 1, 0)
    assert found[3, 2] == (4, 4, 1)
    assert found[4, 0] == (1, 0, None) and found[4, 2] == (1, 0, None)
    assert found[1, 0] == (0, 0, None)


def generated():
    """Messages that quote others: nested, partial, repeated, interleaved, changed."""
    rng = random.Random(11)
    rows = []
    for conv in range(60):
        texts = []
        for turn in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if texts and rng.random() < 0.8:
                    source = rng.choice(texts).split("\n")
                    a = rng.randrange(len(source))
                    part = source[a : a + rng.choice([1, 2, 2, 3, 9])]
                    if rng.random() < 0.2:
                        part = [x for x in part if rng.random() < 0.8] or ["none"]
                    lines += ["> " * rng.choice([1, 1, 1, 2]) + (x.upper() if rng.random() < 0.2 else x) for x in part]
                lines += [rng.choice(["yes", "no", "w1 w2", "", "w3  w4", f"own {conv % 3} {turn}", "same line"]) for _ in range(rng.randint(0, 4))]
            texts.append("\n".join(lines) or rng.choice(["x", "", "a\n\nb"]))
            rows.append((conv, rng.choice([turn, turn, turn, 1, None]), rng.choice(["u", "a", None]), texts[-1]))
    rows += [(5, 2, "u", None), (None, 1, "u", "> yes"), (7, 0, "u", "yes\nno"), (7, 0, "u", "yes\nno")]
    return rows


def test_generated_quotes_against_sql(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    messages = spark.createDataFrame(generated(), schema)
    messages.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = quotes.op10_quotes(spark, str(tmp_path))
    assert compare.differences(found, con, quotes.OP10_SQL) == []
    linked = found.agg(F.sum("n_linked"), F.sum("n_quotes")).first()
    assert 100 < linked[0] < linked[1]


def test_originals_do_not_depend_on_the_layout(spark):
    """Of two messages with one turn that say a passage, role and text decide."""
    rows = [(1, 0, "b", "p\nq"), (1, 0, "a", "p\nq\nr"), (1, 0, "a", "p\nq"), (1, 1, "u", "> p\n> q\nso"), (1, 1, "u", "x")]
    schema = "conv_id long, turn long, role string, text string"
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        out = quotes.link_quotes(spark.createDataFrame(order, schema).repartition(3))
        seen.add(tuple(sorted(map(repr, map(tuple, out.collect())))))
    assert len(seen) == 1
