"""Texts are aligned by pieces that are remembered; the results are those of whole texts."""

import pathlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import hard_rows, prose

from vecprune.llm import align

FILES = [pathlib.Path(public_tokenizers.path(n)).read_bytes() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def tokens():
    return align.Tokens(*FILES)


def _texts():
    rng = random.Random(11)
    signs = ["a", "b's", "I'll", " ", "  ", "\n", "\t", "\xa0", " ", "▁", "́", "é", "ñ", "à", "ж", "ب", "\x85", "\u2003", "\u3000", "中", "7", "...", "<s>", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(400)]
    texts += [" ".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(400)]
    return texts + [t or "" for _, t, *_ in hard_rows() if len(t or "") < 20_000] + [prose(5, 900), "<|endoftext|> x", " ", "y "]


def test_pieces_give_what_whole_texts_give(tokens):
    assert tokens.apart
    texts, whole = _texts(), align.Tokens(*FILES)
    whole.apart = False
    want = align.Documents(align.Pieces(whole), texts)
    assert (want.n_a == 0).any() and (want.n_a > 0).sum() > 100
    for limit, step in ((align.MEMO_BYTES, len(texts)), (20_000, 37)):
        pieces, at = align.Pieces(tokens, limit), 0
        for low in range(0, len(texts), step):
            rows = slice(low, low + step)
            got = align.Documents(pieces, texts[rows])
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                assert getattr(got, name).tolist() == getattr(want, name)[rows].tolist(), name
            assert got.digests == want.digests[rows]
            assert np.array_equal(got.pair, want.pair[at : at + len(got.pair)])
            assert np.array_equal(got.doc + low, want.doc[at : at + len(got.doc)])
            at += len(got.pair)
        assert at == len(want.pair)


def test_each_piece_is_encoded_once(tokens, monkeypatch):
    encoded = []
    monkeypatch.setattr(tokens, "encode", lambda blocks: [encoded.extend(b) for b in blocks] and align.Tokens.encode(tokens, blocks))
    pieces, texts = align.Pieces(tokens), [prose(1, 500), prose(2, 500), prose(1, 500)]
    for _ in range(3):
        align.Documents(pieces, texts)
    assert len(encoded) == len(set(encoded)) < sum(len(t.split()) for t in texts)


def test_other_rules_are_not_taken_apart():
    json = FILES[0].decode()
    assert align.a_apart(FILES[0]) and align.b_apart(FILES[1])
    assert not align.a_apart(json.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false').encode())
