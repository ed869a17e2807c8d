"""What the pipeline keeps of near-duplicates, by brute-force fingerprints, whatever the columns are called."""

import random

import brute
from conftest import prose
from test_pipeline import one_of_each

from vecprune.llm.simhash import keep_one_of_each


def near_copies():
    rng, rows = random.Random(9), []
    for k in range(40):
        words = prose(600 + k, rng.choice([6, 90, 300, 900])).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randint(0, 2) // 100)):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    return rows + [(len(rows) + n, t) for n, t in enumerate(["", None, "a b", "A  b", None])]


def test_kept_as_by_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in keep_one_of_each(docs).collect())
    assert got == sorted(i for i, _ in one_of_each(rows))
    assert len(got) < len({brute.fingerprint(t) for _, t in rows})


def test_columns_of_any_name_keep_their_values(spark):
    names = ["print", "row", "node", "label", "first", "_node", "_lists", "_row", "Row_", "list", "n"]
    rows = [(i, prose(i // 2, 40), *range(100 * i, 100 * i + len(names))) for i in range(10)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names)
    docs = spark.createDataFrame(rows, schema)
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == rows[::2]
