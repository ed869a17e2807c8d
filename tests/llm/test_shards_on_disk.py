"""What training writes to disk: ids of a text once, and a shard as one row that all rounds read."""

import numpy as np
import public_tokenizers
from conftest import prose
from pyspark.sql import functions as F

from vecprune.llm import attention, lm
from vecprune.llm.bpe import read_ranks


def test_windows_are_made_from_texts_and_dealt_whole(spark):
    texts = [None, "", "one", *[prose(k, 30 * k) for k in range(1, 30)], prose(3, 90)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    content = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    staged = lm.gather_texts(docs, spark.sparkContext.broadcast(content), "text").filter(F.col("kind") == lm.WINDOW)
    windows = lm.unfolded(staged).select("key", "ids").collect()
    assert staged.agg(F.sum("n")).first()[0] == len(windows)
    # Texts once, not windows that overlap.
    assert staged.agg(F.sum(F.length("ids"))).first()[0] < 0.75 * sum(len(r.ids) for r in windows)
    source = spark.createDataFrame(windows, "key long, ids binary").repartition(5)
    rows = lm.shards_of(source, lm.windows_of_rows, 4).collect()
    assert sorted(r.shard for r in rows) == [0, 1, 2, 3]
    assert sorted(lm.shards_of(staged, lm.windows_of_texts, 4).collect()) == sorted(rows)
    for r in rows:
        want = sorted((w.key, bytes(w.ids)) for w in windows if w.key % 4 == r.shard)
        ids = lm.unpacked(r.ids, 0)[1].reshape(r.n, attention.LENGTH + 1)
        assert [x.astype("<u2").tobytes() for x in ids] == [x for _, x in want]


def test_packed_values_come_back():
    longs, ids = np.array([-5, 1 << 62, 0]), np.array([0, 255, 256, 65535, 7], np.uint16)
    back = lm.unpacked(lm.packed(longs, ids), 3)
    assert back[0].tolist() == longs.tolist() and back[1].tolist() == ids.tolist()
