"""Predictions against a plain version of the two steps, learned families, many languages."""

import math
import zlib

import brute
import numpy as np

from vecprune.llm import langid

FOLDER = "/root/testdata/sf0.001"


def plain_vector(value):
    """Counts of hashed byte pairs and triples, a text at a time."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in (value or "").encode()]
    out = np.zeros(langid.DIM)
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            h = data[i]
            for b in data[i + 1 : i + n]:
                h = (h * 0x01000193 + b) % 2**32
            out[h * (0x9E3779B1 + 2 * n) % 2**32 >> 20] += 1
    norm = math.sqrt(float(out @ out))
    return out / max(norm, 1)


def plain_predict(model, value):
    if not any(map(str.isalpha, value or "")):
        return "und", 0.0
    x = np.append(plain_vector(value), 1.0)
    margins = [float(w @ x) for w in model.by_family]
    family = max(range(len(margins)), key=lambda f: margins[f])
    chance = 1 / (1 + math.exp(-4 * margins[family])) if len(margins) > 1 else 1.0
    group = [int(i) for i in model.members[family]]
    votes, sure = dict.fromkeys(group, 0.0), dict.fromkeys(group, 1.0)
    for a, b, w in model.pairs:
        if a in votes:
            m = float(w @ x)
            for lang, side in ((a, m), (b, -m)):
                votes[lang] += (side >= 0) + 1e-3 * math.tanh(side)
                sure[lang] = min(sure[lang], 1 / (1 + math.exp(-4 * side)))
    best = max(group, key=lambda i: votes[i])
    return model.langs[best], chance * sure[best]


def test_predictions_equal_the_plain_ones(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs.filter(~langid.in_fold("doc_id", 4, 2)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    wrong = 0
    for r in langid.op5_language(spark, FOLDER).collect():
        lang, score = plain_predict(model, texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == brute.in_fold(r.doc_id, 4, 2)
        assert abs(r.score - score) < 1e-3
        wrong += r.lang_pred != lang
    assert wrong == 0


def test_families_are_learned_for_unknown_codes():
    base = np.eye(4)
    means = np.array([base[0], base[1], 0.95 * base[0] + 0.1 * base[3], base[2], 0.9 * base[2] + 0.2 * base[3], base[3]])
    found = langid.families_of(["de", "fr", "qaa", "qab", "qac", "qad"], means)
    assert found[:2] == ["germanic", "romance"] and found[2] == "germanic"
    assert found[3] == found[4] == "of qab" and found[5] == "of qad"


def test_any_number_of_languages_gives_a_result(spark, monkeypatch):
    # Class means in place of machines, which take long for so many.
    monkeypatch.setattr(langid, "fit_machine", lambda x, sign: np.append(sign @ x, 0.0))
    rows = [(i, f"lang{i} " * 5 + "abc" * i, f"q{i % 260:03d}") for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=1)
    assert len(model.langs) == 260
    assert langid.predict(docs.limit(20), model).count() == 20
