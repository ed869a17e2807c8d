"""Texts that repeat a few symbols, each alone: all their equal windows lie within one slice."""

import brute
import pytest
from conftest import prose

from vecprune.llm import anchors, repeats, suffix


def _texts():
    texts = [" ".join([prose(900 + k, k)] * 8) for k in range(8, 30)]
    # Two rows with one text: for the later ones, the first still repeats itself.
    return texts + texts[:1] + ["q" * 450, "w " * 40, prose(950, 300)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("module", [suffix, anchors])
def test_repeats_within_one_slice(spark, module, keep_first):
    rows = list(enumerate(_texts()))
    if module is suffix:
        window, symbols = suffix.WINDOW, [t.encode() for _, t in rows]
    else:
        window, symbols = anchors.WINDOW, [tuple(brute.words(t)) for _, t in rows]
    want = (brute.later if keep_first else brute.repeated)(symbols, window)
    assert sum(any(gone) for gone in want) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.id: r.spans for r in module.removals(docs, keep_first=keep_first).collect()}
    for (i, _), gone in zip(rows, want):
        mine = [False] * len(gone)
        for a, b in repeats.merged(found[i]):
            mine[a:b] = [True] * (b - a)
        assert mine == gone, i
