"""Passages of benchmark items at every offset, verbatim and edited."""

import random

import pytest
from conftest import prose

from vecprune.llm import decontaminate


def _found(search, docs):
    return set(search.hits([decontaminate.normalised(d) for d in docs])[0].tolist())


@pytest.mark.parametrize("size", [101, 120, 150, 151, 300])
def test_passages_at_every_offset(size):
    item = decontaminate.normalised(prose(800, 120))[:size].strip().ljust(size, "z")
    search = decontaminate.Search(decontaminate.cut([(0, item)]))
    for length in {100, min(140, size)}:
        docs = [f"{prose(801, 20)} # {item[a : a + length]} # {prose(802, 20)}" for a in range(size - length + 1)]
        assert _found(search, docs) == set(range(len(docs)))
    # Less than a passage is none.
    docs = [f"{prose(801, 20)} ### {item[a : a + 80]} ### {prose(802, 20)}" for a in range(size - 80 + 1)]
    assert not _found(search, docs)


def test_edited_passages_at_every_offset():
    rng = random.Random(11)
    item = decontaminate.normalised(prose(803, 120))[:300].strip().ljust(300, "z")
    search = decontaminate.Search(decontaminate.cut([(0, prose(804, 50)), (1, item)]))
    docs = []
    for at in range(201):
        chars = list(item[at : at + 100])
        for place in rng.sample(range(100), 5):
            # Without a word of one letter: its blanks would become one, which is an edit more.
            alone = " " in "".join(chars[max(0, place - 1) : place + 2])
            chars[place] = rng.choice(["#", chars[place] + "#", "#" if alone else ""])
        docs.append(f"{prose(805, 20)} {''.join(chars)} {prose(806, 20)}")
    assert _found(search, docs) == set(range(201))


def test_short_items_as_a_whole():
    """Items of up to 150 characters keep the edits of their own length."""
    item = decontaminate.normalised(prose(807, 80))[:150].strip().ljust(150, "z")
    search = decontaminate.Search(decontaminate.cut([(0, item)]))
    chars = list(item)
    for place in range(55, 90, 5):
        chars[place] = "#"
    assert _found(search, [f"{prose(808, 20)} {''.join(chars)} {prose(809, 20)}"]) == {0}
