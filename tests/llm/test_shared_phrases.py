"""Decontamination with phrases that many items share, short items, and a whole table by brute force."""

import random

import numpy as np
from conftest import prose

from vecprune.llm import decontaminate


def least_edits(span: str, doc: str) -> int:
    """Edit distance of the span to the best part of the document."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(span):
        new = [i + 1]
        for j, d in enumerate(doc):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, text: str, n: int) -> str:
    chars = list(text)
    for place in rng.sample(range(2, len(chars) - 2, 4), n):
        chars[place] = rng.choice(["#", chars[place] + "#"])
    return "".join(chars)


def test_table_by_brute_force(spark):
    rng = random.Random(5)
    shared = decontaminate.normalised(prose(900, 40))[:104].strip().ljust(104, "z")
    items = [f"{prose(910 + k, 4)} {shared} {prose(920 + k, 4)}" for k in range(3)] + [prose(930, 9)[:60], "Ab 1", None, ""]
    items += items[:1]
    docs = [None, "", prose(940, 30), f"x ab\n1! {prose(941, 20)}", f"cab 1 {prose(942, 20)}"]
    for k, n in enumerate((0, 3, 5, 9)):
        docs.append(f"{prose(950 + k, 9)} {edited(rng, shared, n)} {prose(960 + k, 9)}")
        docs.append(f"{prose(970 + k, 9)} {edited(rng, items[3], n)} {prose(980 + k, 9)}")
    docs.append(f"{prose(990, 9)} {items[1]} {prose(991, 9)}")
    docs += docs[-1:]
    rows = [(n % (len(docs) - 1), t, "t", 1) for n, t in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, number string, piece_text long").repartition(3)
    benchmark = spark.createDataFrame([(n % 7, t, 0) for n, t in enumerate(items)], "item_id int, text string, number int")

    def holds(doc, item) -> bool:
        doc, item = decontaminate.normalised(doc), decontaminate.normalised(item)
        if not doc or not item:
            return False
        if len(item) < decontaminate.Q:
            return f" {item} " in "".join(c if c.isalnum() else " " for c in f" {doc} ")
        size = decontaminate.PASSAGE
        spans = [item] if len(item) <= size else [item[a : a + size] for a in range(len(item) - size + 1)]
        if size < len(item) <= decontaminate.WHOLE:
            spans.append(item)
        return any(least_edits(s, doc) <= len(s) * 5 // 100 for s in spans)

    want = sorted((i, n % 7) for i, t, *_ in rows for n, item in enumerate(items) if holds(t, item))
    got = decontaminate.benchmark_hits(table, benchmark)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want
    kept = decontaminate.drop_contaminated(table, benchmark)
    assert kept.columns == table.columns
    clean = [t for t in docs if not any(holds(t, item) for item in items)]
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, clean))
    assert 5 < len(clean) < len(docs) - 4


def test_many_items_with_one_phrase():
    """Alignments grow with the different pieces at the phrase's ends, far less than with the items."""
    phrase = decontaminate.normalised(prose(800, 60))[:130]

    def aligned(n: int) -> tuple[int, np.ndarray]:
        items = [f"{prose(5000 + k, 12)} {phrase} {prose(8000 + k, 12)}" for k in range(n)]
        search, seen = decontaminate.Search(decontaminate.cut(list(enumerate(items)))), []
        plain = search._align
        search._align = lambda *spans: seen.append(len(spans[3])) or plain(*spans)
        docs = [f"{prose(k, 30)} {phrase} {prose(k + 3, 30)}" for k in range(20)] + [prose(70, 99)]
        found = search.contaminated(docs)
        assert found.tolist() == [True] * 20 + [False]
        return sum(seen), search

    few, _ = aligned(100)
    many, search = aligned(600)
    assert many < 3 * few
    text, holder, edits, _ = search.hits([f"{prose(1, 30)} {phrase} {prose(4, 30)}"])
    assert set(search.pieces.item[holder[edits == 0]].tolist()) == set(range(600))


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_CHARS", 500)
    items = [prose(300 + k, 40) for k in range(12)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = decontaminate._texts(benchmark.select(benchmark.text.alias("piece_text")))
    assert len(list(decontaminate._parts(texts))) > 2
    docs = spark.createDataFrame([(k, f"{prose(k, 9)} {t} {prose(k, 5)}") for k, t in enumerate(items)], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in decontaminate.benchmark_hits(docs, benchmark).collect()) == [(k, k) for k in range(12)]
    assert decontaminate.drop_contaminated(docs, benchmark).count() == 0


def test_only_short_items():
    search = decontaminate.Search(decontaminate.cut([(0, "Yes"), (1, None), (2, " yes "), (3, "C 3")]))
    docs = ["oh yes.", "yesterday", "", "abc 3", "a c 3"]
    assert search.contaminated(docs).tolist() == [True, False, False, False, True]
    text, holder, edits, place = search.hits(docs)
    found = zip(text.tolist(), search.pieces.item[holder].tolist(), edits.tolist(), place.tolist())
    assert sorted(found) == [(0, 0, 0, 3), (0, 2, 0, 3), (4, 3, 0, 2)]
    assert not search.contaminated([]).size and not len(search.hits([])[0])
    assert decontaminate.cut([(0, None), (1, " ")]) is None
