"""Words are hashed many at once, to the buckets of their MD5."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from vecprune.operators import encode


def _words():
    rng = random.Random(6)
    lengths = [*range(140), *(rng.randrange(1, 70) for _ in range(2000))]
    ascii_words = ["".join(rng.choices("abcxyz0189-_.", k=n)) for n in lengths]
    return ascii_words + ["é" * n + "ü漢😀" for n in range(40)] + ["\x00", "a\x00b", "\x7f" * 55, "\x7f" * 56]


@pytest.mark.parametrize("dim", [1, 7, 256, 1 << 20])
def test_buckets_are_those_of_md5(monkeypatch, dim):
    monkeypatch.setattr(encode, "HASHED_WORDS", 100)
    words = _words()
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words]
    for kind in (pa.string(), pa.large_string()):
        some = pa.array(["before", *words, "after"], kind).slice(1, len(words))
        assert encode._buckets(some, dim).tolist() == want
    assert encode._buckets(pa.array([], pa.string()), dim).tolist() == []


def test_words_are_not_hashed_one_by_one(spark, monkeypatch):
    alone = []
    bucket = encode._bucket
    monkeypatch.setattr(encode, "_bucket", lambda word, dim: (alone.append(word), bucket(word, dim))[1])
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(40)] + ["", "  ", " a  b\t", "z" * 60]
    (found,) = encode._bag_counts(16, False).func(iter([pa.array(texts)]))
    for text, row in zip(texts, found.to_pylist()):
        assert np.array_equal(row, np.bincount([bucket(w, 16) for w in text.split()], minlength=16))
    assert len(alone) == 1
