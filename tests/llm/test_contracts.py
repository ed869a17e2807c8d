"""The queries on hard rows, held against plain versions, and on empty tables."""

import collections

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vecprune.llm.bpe import Encoder, read_ranks
from vecprune.llm.queries import QUERIES


def by_row(rows, columns):
    """Rows as a multiset of tuples; floats rounded."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return collections.Counter(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_quality(spark, hard_dir, hard):
    columns = ["doc_id", *brute.quality(""), "dup_chars_5", "dup_chars_10"]
    want = [
        {"doc_id": i, **brute.quality(t), **{f"dup_chars_{n}": brute.later_chars(t, n) for n in (5, 10)}}
        for i, t, *_ in hard
    ]
    got = QUERIES["op1_repetition"](spark, hard_dir).collect()
    assert by_row(got, columns) == by_row(want, columns)
    assert all(not r.kept for r in got if r.base_failed)


def test_simhash(spark, hard_dir, hard):
    prints = [brute.fingerprint(t) for _, t, *_ in hard]
    parts = brute.components(prints)
    first = {}
    for (i, *_), p in zip(hard, prints):
        if i is not None:
            first[parts[p]] = min(first.get(parts[p], i), i)
    want = [
        {"doc_id": i, "fingerprint": f"{p:016x}", "component_id": first.get(parts[p])}
        for (i, *_), p in zip(hard, prints)
    ]
    columns = ["doc_id", "fingerprint", "component_id"]
    assert by_row(QUERIES["op2_simhash"](spark, hard_dir).collect(), columns) == by_row(want, columns)


def test_byte_repeats(spark, hard_dir, hard):
    texts = [(t or "").encode() for _, t, *_ in hard]
    want = []
    for (i, *_), data, gone in zip(hard, texts, brute.repeated(texts, 400)):
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want.append(
            {"doc_id": i, "n_bytes": len(data), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": brute.sha(kept)}
        )
    columns = list(want[0])
    assert by_row(QUERIES["op3_suffix"](spark, hard_dir).collect(), columns) == by_row(want, columns)


def test_word_repeats(spark, hard_dir, hard):
    lists = [tuple(brute.words(t)) for _, t, *_ in hard]
    want = []
    for (i, *_), ws, gone in zip(hard, lists, brute.repeated(lists, 35)):
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        want.append({"doc_id": i, "n_words": len(ws), "n_removed": sum(gone), "kept_sha256": brute.sha(kept.encode())})
    columns = list(want[0])
    assert by_row(QUERIES["op4_anchors"](spark, hard_dir).collect(), columns) == by_row(want, columns)


def test_language(spark, hard_dir, hard):
    got = QUERIES["op5_language"](spark, hard_dir).collect()
    assert len(got) == len(hard)
    for r in got:
        assert r.held_out == brute.in_fold(r.doc_id, 4, 2)
        assert r.lang_pred in ("xx", "yy", "und") and 0 <= r.score <= 1
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {0, 1, 2, 16} <= unknown and not unknown & {3, 8, 15, 17}


def test_personal_data(spark, hard_dir, hard):
    want = []
    for i, t, *_ in hard:
        spans = brute.base_spans(t)
        digest = brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())
        want.append({"doc_id": i, "base_sha256": digest} | {f"n_{k}": sum(s[0] == k for s in spans) for k in brute.PATTERNS})
    columns = list(want[0])
    got = QUERIES["op6_pii"](spark, hard_dir).collect()
    assert by_row(got, columns) == by_row(want, columns)
    for r in got:
        text = next(t for i, t, *_ in hard if i == r.doc_id and i is not None) if r.doc_id is not None else None
        if r.doc_id in (18, 19):
            base = {f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text)}
            assert base <= set(r.spans.split(","))


def test_decontamination(spark, hard_dir):
    got = QUERIES["op7_decontaminate"](spark, hard_dir).collect()
    # The item is there twice.
    assert collections.Counter((r.doc_id, r.item_id) for r in got) == {(9, 0): 2, (10, 0): 2, (11, 0): 2}
    assert all(r.least_edits == 0 and r.n_pieces > 1 for r in got)


def test_bpe(spark, hard_dir, hard):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Encoder.parse(read_ranks(path)), special_tokens={}
    )
    want = []
    for i, t, *_ in hard:
        ids = plain.encode_ordinary(t or "")
        data = np.array(ids, "<u4").tobytes()
        want.append(
            {"doc_id": i, "n_tokens": len(ids), "ids_sha256": brute.sha(data), "decoded_sha256": brute.sha((t or "").encode())}
        )
    columns = list(want[0])
    assert by_row(QUERIES["op8_byte_bpe"](spark, hard_dir).collect(), columns) == by_row(want, columns)


def test_scores(spark, hard_dir, hard):
    want = []
    for (i, *_), (n, known, total, score) in zip(hard, brute.base_scores([(i, t) for i, t, *_ in hard])):
        want.append(
            {"doc_id": i, "held_out": brute.in_fold(i, 5, 1), "n_tokens": n, "n_known": known, "train_tokens": total, "base_score": round(score, 6)}
        )
    columns = list(want[0])
    got = QUERIES["op9_attention_scores"](spark, hard_dir).collect()
    assert by_row(got, columns) == by_row(want, columns)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
