"""The language model learns from all training text."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import prose

from vecprune.llm import attention, lm
from vecprune.llm.bpe import read_ranks


def test_all_training_text_is_in_the_windows(spark):
    content = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [prose(n, size) for n, size in enumerate([3, 20, 60, 500])] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    gathered = lm.gather(docs, spark.sparkContext.broadcast(content), "text")
    rows = gathered.filter(f"kind = {lm.WINDOW}").select("ids").collect()
    got = sorted(bytes(r.ids) for r in rows)
    chunk = lm.Subwords(content).ids(pa.array(texts, pa.string()))
    ids, scored = chunk.windows(np.arange(len(chunk.owner)))
    assert got == sorted(row.astype(np.uint16).tobytes() for row in ids)
    assert scored.sum() == len(chunk.ids) and attention.LENGTH == 32 and attention.CONTEXT == 8
