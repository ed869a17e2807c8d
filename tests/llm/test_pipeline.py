"""The pipeline against plain versions of its stages, each on what the one before kept."""

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vecprune.llm import pii
from vecprune.llm.bpe import Encoder, read_ranks
from vecprune.llm.repetition import GRAM_PERCENT, LINE_PERCENT

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(text) -> bool:
    q, seen, line_chars = brute.quality(text), set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            line_chars += sum(map(len, brute.words(line))) * (line in seen)
            seen.add(line)
    limits = [100 * brute.later_chars(text, n) <= p * q["word_chars"] for n, p in GRAM_PERCENT.items()]
    return not q["base_failed"] and all(limits) and 100 * line_chars <= LINE_PERCENT * q["word_chars"]


def one_of_each(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    parts, best = brute.components(prints), {}
    for n, ((i, _), p) in enumerate(zip(rows, prints)):
        key = (i is None, i or 0, n)
        best[parts[p]] = min(best.get(parts[p], key), key)
    return [rows[n] for *_, n in sorted(best.values())]


def plain(rows, items):
    rows = one_of_each([r for r in rows if good(r[1])])
    items = [" ".join(x.lower().split()) for x in items if x and len(x) >= 60]
    rows = [r for r in rows if not any(x in " ".join(r[1].lower().split()) for x in items)]
    model = pii.train()
    rows = [(i, pii.masked(t, sum(pii.find([t], model)[0], []))) for i, t in rows]
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    coder = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Encoder.parse(read_ranks(path)), special_tokens={}
    )
    out = []
    for i, t in rows:
        ids = coder.encode_ordinary(t)
        out.append((str(i), len(ids), ids, brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t.encode())))
    return sorted(out)


@pytest.mark.parametrize("source", ["hard", "sf0.001"])
def test_rows(spark, hard_dir, source):
    folder = hard_dir if source == "hard" else "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain([tuple(r) for r in documents], items)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert want


def test_stages_keep_the_columns(spark, empty_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, empty_dir)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS
            docs = out
