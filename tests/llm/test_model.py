"""The model's score against a plain forward pass, and its independence of the partitions."""

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from vecprune.llm import attention, lm
from vecprune.llm.bpe import Encoder, read_ranks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain_log10(params, slots, ids):
    """Log-probability of a text's ids, a token at a time."""
    p, total = params, 0.0
    start = 0
    while True:
        some = ids[start : start + attention.LENGTH]
        before = [ids[start - 1] if start else lm.BEFORE]
        inputs = [int(slots.slot[i]) for i in before + some[:-1]]
        for n, token in enumerate(some):
            if start and n < attention.CONTEXT:
                continue
            e = p["embed"][inputs[: n + 1]].astype(float)
            q = e[n] @ p["query"] / math.sqrt(attention.WIDTH)
            z = np.array([q @ (e[j] @ p["key"]) + p["bias"][n - j] for j in range(n + 1)])
            att = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            h = np.tanh((att @ (e @ p["value"]) + e[n]) @ p["mix"] + p["mix_bias"])
            high, low = divmod(int(slots.slot[token]), attention.SIDE)
            for z, at in ((h @ p["high"] + p["high_bias"], high), (h @ p["low"] + p["low_bias"][high], low)):
                total += z[at] - math.log(np.exp(z).sum())
            total += slots.within[token]
        if start + attention.LENGTH >= len(ids):
            return total / math.log(10)
        start += attention.STRIDE


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i // 2, 20 + 9 * (i % 11))) for i in range(120)] + [(500, None), (501, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").persist()


def test_score_equals_a_plain_forward_pass(spark, docs):
    content = read_ranks(RANKS)
    reader = lm.Subwords(content)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: reader.ids(pa.array([t], pa.string())).ids.astype(int).tolist() for i, t in texts.items()}
    counts = np.bincount([x for some in ids.values() for x in some], minlength=lm.N_IDS)
    slots = lm.Slots(counts, 1 + max(Encoder.parse(content).values()))
    gathered = lm.gather(docs, spark.sparkContext.broadcast(content), "text")
    params = lm.train_model(gathered.filter(F.col("kind") == lm.WINDOW).select("key", "ids"), slots)
    got = {r.doc_id: r.score for r in lm.scores(docs, docs, RANKS).collect()}
    for i, some in ids.items():
        assert got[i] == pytest.approx(plain_log10(params, slots, some), rel=2e-4, abs=1e-3)


def test_scores_do_not_depend_on_the_partitions(spark, docs):
    """The weights are equal; products in single precision differ in the last digits by batch."""
    found = []
    for n in (1, 4, 8):
        some = docs.repartition(n)
        rows = lm.scores(some, some, RANKS).select("doc_id", "score").collect()
        found.append([r.score for r in sorted(rows)])
    np.testing.assert_allclose(found[1], found[0], rtol=1e-6)
    np.testing.assert_allclose(found[2], found[0], rtol=1e-6)


def test_shards_are_the_same_for_any_layout(spark, docs):
    """Several shards, and streams that are cut anywhere."""
    content = read_ranks(RANKS)
    found = []
    for n in (1, 5):
        gathered = lm.gather(docs.repartition(n), spark.sparkContext.broadcast(content), "text")
        windows = gathered.filter(F.col("kind") == lm.WINDOW).select("key", "ids")
        slots = lm.Slots(np.ones(lm.N_IDS), 1000)
        found.append(attention.flat(lm.train_model(windows.repartition(n), slots, shard_windows=100)))
    assert np.array_equal(*found)
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 50, (300, attention.LENGTH + 1))
    weight = np.ones((300, attention.LENGTH), np.float32)
    params = attention.initial(np.ones(attention.SLOTS))
    whole = attention.flat(attention.descend(params, windows, weight, 0.02, 64))
    cut = attention.Descent(params, 0.02, 64)
    for a in range(0, 300, 37):
        cut.feed(windows[a : a + 37], weight[a : a + 37])
    assert np.array_equal(whole, attention.flat(cut.end()))
