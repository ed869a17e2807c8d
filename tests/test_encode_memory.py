"""Counting the words of a large batch takes memory for a part of it."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from vecprune.operators import encode


def test_words_of_a_batch_are_counted_in_parts(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(vocabulary, k=700)) for _ in range(4000)] + ["", " \t ", "one  two\none"]
    count = encode._bag_counts(16, False).func
    batch = pa.array(texts)
    tracemalloc.start()
    found = list(count(iter([batch, pa.array([], pa.string())])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(f) for f in found] == [len(texts), 0]
    # 14 MB of text: an array of 8 bytes a word alone takes 22 MB.
    assert peak < 30e6
    for i in [0, 1999, 3999, 4000, 4001, 4002]:
        want = collections.Counter(encode._bucket(w, 16) for w in texts[i].split())
        assert np.array_equal(found[0][i].as_py(), [want[b] for b in range(16)])
