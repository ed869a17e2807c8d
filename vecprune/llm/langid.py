"""Language identification in two steps: first the family, then the language within it.

Features are counts of hashed byte n-grams of the whole text, in lower case and without digits
and punctuation, each text's vector having length one.  A linear support vector machine per
family (one against the rest) chooses the family; within it one-versus-one machines for each
two languages vote, their margins breaking ties.

The machines are fitted on at most ``TRAIN_PER_LANGUAGE`` labelled documents of each language,
those with the smallest hash of id and text; the bound is a parameter.  Their feature vectors,
not their texts, go to the driver.  Prediction reads every document, with no shuffle.

Defined results: ``und`` with score 0 for a text that is NULL or has no letter, or if nothing
could be learned; rows without a language teach nothing; a NULL id is never held out; repeated
rows are predicted one by one; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from vecprune.llm.text import add_columns, chunks, text_bytes
from vecprune.session import ship_package
from vecprune.staging import stage_table

DIM = 4096
ORDERS = (2, 3)
TRAIN_PER_LANGUAGE = 400
# Labelled documents of all languages together: with very many languages each has fewer.
TRAIN_ROWS = 102_400
# A language whose code is in no family joins the one whose mean vector is as near as this.
SAME_FAMILY = 0.8
UNKNOWN = "und"
# Families of common languages by their code; others are learned.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "ar am he mt",
    "malayic": "id jv ms su",
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def _fold() -> np.ndarray:
    """Bytes to themselves, upper to lower case, everything else below 128 to a space."""
    table = np.arange(256, dtype=np.uint8)
    letters = [*range(65, 91), *range(97, 123)]
    table[[b for b in range(128) if b not in letters]] = 32
    table[65:91] += 32
    return table


_FOLD = _fold()


def families_of(langs: list[str], means: np.ndarray) -> list[str]:
    """The family of each language: by its code, else learned from the mean vectors.

    A language without a known code joins the family of the nearest language whose mean has a
    cosine of ``SAME_FAMILY`` or more with its own, known ones first; else it begins one.
    """
    codes = [lang.lower().replace("_", "-").split("-")[0] for lang in langs]
    family = [_FAMILY_OF.get(code) for code in codes]
    unit = means / np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-12)
    for i in [i for i, f in enumerate(family) if f is None]:
        done = [j for j, f in enumerate(family) if f is not None]
        near = unit[done] @ unit[i] if done else np.zeros(0)
        joins = len(near) and near.max() >= SAME_FAMILY
        family[i] = family[done[int(near.argmax())]] if joins else f"of {langs[i]}"
    return family


def has_letter(texts: pa.Array, folded: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Does the text have a letter?  Only texts without an ASCII letter are looked at twice."""
    seen = np.zeros(len(folded) + 1, np.int64)
    np.cumsum((folded >= 97) & (folded <= 122), out=seen[1:])
    out = np.diff(seen[offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return out


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A feature vector per text, and whether the text has a letter."""
    data, offsets = text_bytes(texts)
    folded = _FOLD[data]
    out = np.zeros((len(texts), DIM), np.float32)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * DIM, np.diff(offsets))
    wide = folded.astype(np.uint32)
    hashed = wide
    for order in range(2, max(ORDERS) + 1):
        n = len(folded) - order + 1
        if n <= 0:
            break
        hashed = hashed[:n] * np.uint32(0x01000193) + wide[order - 1 :]
        if order in ORDERS:
            spread = hashed * np.uint32(0x9E3779B1 + 2 * order)
            slot = (spread >> np.uint32(20)).astype(np.int64) + owner[:n]
            whole = owner[:n] == owner[order - 1 :]
            flat += np.bincount(slot[whole], minlength=len(flat)).astype(np.float32)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1), has_letter(texts, folded, offsets)


def fit_machine(x: np.ndarray, sign: np.ndarray, rounds: int = 120, cost: float = 20.0) -> np.ndarray:
    """A linear SVM with squared hinge loss by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    # Both sides weigh the same.
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))
    step = 1 / (1 + 4 * cost)
    w = ahead = np.zeros(x.shape[1])
    for i in range(rounds):
        short = np.maximum(0, 1 - sign * (x @ ahead))
        slope = ahead - 2 * cost * (x.T @ (weight * sign * short))
        new = ahead - step * slope
        w, ahead = new, new + i / (i + 3) * (new - w)
    return w


@dataclass
class Classifier:
    families: list[str]
    by_family: np.ndarray  # a machine per family
    members: list[np.ndarray]  # languages of each family
    pairs: list[tuple[int, int, np.ndarray]]  # within families
    langs: list[str]

    @staticmethod
    def fit(x: np.ndarray, lang: np.ndarray) -> Classifier:
        langs = sorted(set(lang.tolist()))
        code = np.searchsorted(langs, lang)
        of = families_of(langs, np.array([x[code == i].mean(axis=0) for i in range(len(langs))]))
        families = sorted(set(of))
        family = np.searchsorted(families, np.array(of))[code]
        machines = [fit_machine(x, np.where(family == f, 1.0, -1.0)) for f in range(len(families))]
        members = [np.flatnonzero(np.array(of) == f) for f in families]
        pairs = []
        for group in members:
            for a, b in combinations(group.tolist(), 2):
                rows = (code == a) | (code == b)
                pairs.append((a, b, fit_machine(x[rows], np.where(code[rows] == a, 1.0, -1.0))))
        return Classifier(families, np.array(machines), members, pairs, langs)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores from 0 to 1."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = x @ self.by_family.T.astype(np.float32)
        family = margin.argmax(axis=1)
        chance = 1 / (1 + np.exp(-4 * np.clip(margin.max(axis=1), -20, 20)))
        if len(self.families) == 1:
            chance[:] = 1.0
        votes = np.full((len(x), len(self.langs)), -np.inf)
        for f, group in enumerate(self.members):
            votes[np.ix_(family == f, group)] = 0
        least = np.full((len(x), len(self.langs)), 1.0)
        for a, b, w in self.pairs:
            m = np.clip(x @ w.astype(np.float32), -20, 20)
            for lang, side in ((a, m), (b, -m)):
                # A vote, and the margin to break ties among equal votes.
                votes[:, lang] += (side >= 0) + 1e-3 * np.tanh(side)
                least[:, lang] = np.minimum(least[:, lang], 1 / (1 + np.exp(-4 * side)))
        best = votes.argmax(axis=1)
        return best, chance * least[np.arange(len(x)), best]


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Is the CRC of the id, written as text, in this fold?"""
    text = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % folds == fold, F.lit(False))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = TRAIN_PER_LANGUAGE,
) -> Classifier | None:
    """Machines from a bounded sample of labelled rows; None if there is no labelled row."""
    ship_package(labelled.sparkSession)
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count()
    n_langs = counts.count()
    if n_langs == 0:
        return None
    per_language = max(1, min(per_language, TRAIN_ROWS // n_langs))
    # Rows with a hash below a share of its range hold the smallest hashes of each language, and
    # only those, about four times the bound, are ranked: not a whole language in one task.
    near = rows.select("id", "lang", F.length("text").alias("size")).withColumn("hash", F.xxhash64("id", "size"))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count"))
    near = near.join(F.broadcast(counts) if n_langs <= TRAIN_ROWS else counts, "lang").filter(F.pmod("hash", F.lit(1 << 32)) < share * (1 << 32))
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 32)), "hash", "id", "size")
    ranked = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language)
    # At most TRAIN_ROWS rows; texts that were not chosen never reach Python.
    chosen = stage_table(ranked.select(F.col("id").alias("of"), F.col("lang").alias("of_lang")), "langid-chosen")
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("lang") == F.col("of_lang"))
    picked = rows.join(F.broadcast(chosen.distinct()), same, "left_semi")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                x, letter = vectors(part.column("text"))
                made = add_columns(part, ["id", "lang"], x=pa.array(list(x.astype("<f4")), pa.list_(pa.float32())))
                yield made.filter(pa.array(letter))

    kind = labelled.schema[id_col].dataType.simpleString()
    made = picked.mapInArrow(kernel, f"id {kind}, lang string, x array<float>")
    # Rows that repeat an id count once each, but no more of them than the bound.
    some = made.withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ).filter(F.col("nth") <= per_language)
    table = some.select("id", "lang", "x").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    if table.num_rows == 0:
        return None
    x = table.column("x").combine_chunks()
    x = np.asarray(x.flatten(), np.float32).reshape(-1, DIM)
    return Classifier.fit(x, np.array(table.column("lang").to_pylist()))


def predict(
    docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``lang_pred`` and ``score`` for every document."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in chunks(batch, text_col):
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    names = np.full(some.num_rows, UNKNOWN, object)
                    score = np.zeros(some.num_rows)
                    if model is not None:
                        x, letter = vectors(some.column(text_col))
                        best, chance = model.predict(x)
                        names[letter] = np.array(model.langs, object)[best[letter]]
                        score[letter] = chance[letter]
                    yield add_columns(some, [id_col], lang_pred=pa.array(names, pa.string()), score=score)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(kernel, f"`{id_col}` {kind}, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~in_fold("doc_id", 4, 2)))
    found = predict(docs, model)
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
