"""Personal data: base patterns and a linear-chain conditional random field.

The base patterns are found by linear-time forms of their regular expressions.  The model adds
what they don't cover.  It labels white-space tokens by word-shape features; only tokens with a
digit or ``@`` may carry a label, so every maximal run of such tokens is a sequence of its own
with unlabelled ends, and Viterbi over the runs of many texts at once, in numpy, is the decoding
of the whole texts.  The weights have a fixed size; they are trained by the driver from a small
labelled table (at most ``MAX_ROWS`` rows) and broadcast.

A span of the model is added if it looks as its kind must and touches no base span, no match
whose check failed of its own kind, and no failed card of at least 14 digits.

Defined results: a NULL or empty text has no spans; repeated rows are searched one by one; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecprune.llm.pii_table import LABELLED
from vecprune.llm.text import add_columns, chunks
from vecprune.session import ship_package

KINDS = ("email", "ip", "card", "phone")
FEATURES = 1 << 13
MAX_ROWS = 10_000
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (sign := text.find("@", at)) >= 0:
        part = text[max(done, at) : sign]
        local = len(part) - len(part.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, sign + 1) if local else None
        if domain:
            done = domain.end()
            yield sign - local, done
        at = max(done, sign + 1)


def base_matches(text: str) -> list[tuple[Span, bool]]:
    """Matches of the base patterns, each with the outcome of its check."""
    found: list[tuple[Span, bool]] = []
    if not _MARK.search(text):
        return found
    found += [((a, b, "email"), True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        found.append(((*m.span(), "ip"), all(len(p) < 4 and int(p) < 256 for p in parts)))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        found.append(((*m.span(), "card"), 14 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        found.append(((*m.span(), "phone"), 10 <= len(digits) <= 15))
    return found


def joined(spans: Iterable[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


# --- features and sequences ---------------------------------------------------------------


def shape(token: str) -> str:
    """The token with letters as x or X and digits as 0."""
    return "".join(
        "0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token
    )


def _runs_once(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", text, flags=re.S)


def features(tokens: list[str], i: int) -> list[int]:
    token, full = tokens[i], shape(tokens[i])
    before = tokens[i - 1] if i else ""
    after = tokens[i + 1] if i + 1 < len(tokens) else ""
    digits = sum(c == "0" for c in full)
    names = [
        "bias",
        "shape " + full[:24],
        "runs " + _runs_once(full)[:24],
        "head " + full[:3],
        "tail " + full[-3:],
        f"digits {min(digits, 20)}",
        f"size {min(len(token), 24) // 2}",
        "before " + _runs_once(shape(before))[:12],
        "after " + _runs_once(shape(after))[:12],
        "word before " + before.lower().strip(".:,")[:12],
        f"marks {'@' in token}{'(' in token}{'-' in token}{'.' in token}{'/' in token}{'=' in token}",
    ]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def sequences(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[int]]]]:
    """Places and features of the tokens of each run that may be labelled."""
    found = [m.span() for m in re.finditer(r"\S+", text)]
    tokens = [text[a:b] for a, b in found]
    run: list[int] = []
    for i, token in enumerate([*tokens, ""]):
        if token and _MARK.search(token):
            run.append(i)
        elif run:
            yield [found[j] for j in run], [features(tokens, j) for j in run]
            run = []


# --- the model -----------------------------------------------------------------------------

N_LABELS = 1 + 2 * len(KINDS)  # 0: none; then begin and inside of each kind


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Model:
    """Weights of the features and of the transitions; every sequence begins and ends in none."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @staticmethod
    def train(rows: list[tuple[str, list[Span]]], rounds: int = 200, l2: float = 0.02) -> Model:
        """Maximum likelihood by full-batch Adam; the same rows give the same model."""
        x, y = [], []
        for text, spans in rows:
            for places, feats in sequences(text):
                labels = []
                for a, b in places:
                    mine = [s for s in spans if s[0] < b and a < s[1]]
                    kind = 1 + 2 * KINDS.index(mine[0][2]) if mine else 0
                    inside = mine and any(p < a and mine[0][0] < q for p, q in places)
                    labels.append(kind + 1 if inside else kind)
                x.append(feats)
                y.append(labels)
        n, long = len(x), max(map(len, x))
        feats = np.zeros((n, long, len(x[0][0])), np.int64)
        gold, real = np.zeros((n, long), np.int64), np.zeros((n, long), bool)
        for i, (f, g) in enumerate(zip(x, y)):
            feats[i, : len(f)], gold[i, : len(g)], real[i, : len(f)] = f, g, True
        model = Model(np.zeros((FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)))
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.moves)]
        for step in range(1, rounds + 1):
            slopes = model._slopes(feats, gold, real)
            for p, g, (m, v) in zip((model.weights, model.moves), slopes, state):
                g = g / n + l2 * p / n
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return model

    def _slopes(self, feats, gold, real) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the negative log-likelihood: expected minus observed counts."""
        n, long, _ = feats.shape
        unary = self.weights[feats].sum(axis=2)
        alpha = np.zeros((long, n, N_LABELS))
        alpha[0] = unary[:, 0] + self.moves[0]
        for t in range(1, long):
            new = _log_sum(alpha[t - 1][:, :, None] + self.moves, 1) + unary[:, t]
            alpha[t] = np.where(real[:, t, None], new, alpha[t - 1])
        total = _log_sum(alpha[-1] + self.moves[:, 0], 1)
        beta = np.zeros_like(alpha)
        beta[-1] = self.moves[:, 0]
        moves = np.zeros_like(self.moves)
        for t in range(long - 1, 0, -1):
            on = real[:, t, None]
            ahead = unary[:, t] + beta[t]
            beta[t - 1] = np.where(on, _log_sum(self.moves + ahead[:, None, :], 2), beta[t])
            pair = alpha[t - 1][:, :, None] + self.moves + ahead[:, None, :] - total[:, None, None]
            moves += (np.exp(pair) * on[:, :, None]).sum(axis=0)
        share = np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2) * real[:, :, None]
        rows, places = np.nonzero(real)
        weights = np.zeros_like(self.weights)
        change = share.copy()
        change[rows, places, gold[rows, places]] -= 1
        np.add.at(weights, feats[rows, places].ravel(), np.repeat(change[rows, places], feats.shape[2], axis=0))
        # Moves at both ends, and the observed ones.
        last = real.sum(axis=1) - 1
        everyone = np.arange(n)
        moves[0] += share[:, 0].sum(axis=0)
        moves[:, 0] += share[everyone, last].sum(axis=0)
        np.add.at(moves, (np.zeros(n, int), gold[:, 0]), -1)
        np.add.at(moves, (gold[everyone, last], np.zeros(n, int)), -1)
        for t in range(1, long):
            on = real[:, t]
            np.add.at(moves, (gold[on, t - 1], gold[on, t]), -1)
        return weights, moves

    def decode(self, runs: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each run; runs of similar length go through Viterbi together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        size = np.array([len(r) for r in runs], np.int64)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            long = int(size[order[at]])
            some = order[at : at + max(1, 65536 // (2 * long))]
            some = some[size[some] <= 2 * long]
            at += len(some)
            for i, labels in zip(some, self._viterbi([runs[i] for i in some])):
                out[i] = labels
        return out

    def _viterbi(self, runs: list[list[list[int]]]) -> list[np.ndarray]:
        size = np.array([len(r) for r in runs])
        n, long = len(runs), int(size.max())
        unary = np.zeros((long, n, N_LABELS))
        for i, run in enumerate(runs):
            unary[: len(run), i] = self.weights[np.array(run)].sum(axis=1)
        score, back = unary[0] + self.moves[0], np.zeros((long, n, N_LABELS), np.int8)
        ends = np.zeros((n, N_LABELS))
        ends[size == 1] = score[size == 1]
        for t in range(1, long):
            paths = score[:, :, None] + self.moves
            back[t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + unary[t]
            ends[size == t + 1] = score[size == t + 1]
        label = (ends + self.moves[:, 0]).argmax(axis=1)
        labels = np.zeros((n, long), np.int64)
        for t in range(long - 1, -1, -1):
            on = t < size
            labels[on, t] = label[on]
            label = np.where(on, back[t][np.arange(n), label], label)
        return [row[:k] for row, k in zip(labels, size)]


def default_rows() -> list[tuple[str, list[Span]]]:
    """The labelled table of this package as texts and spans."""
    rows = []
    for line in LABELLED:
        text, spans = "", []
        for part in re.split(r"(\[[a-z]+\|[^\]]*\])", line):
            if part.startswith("["):
                kind, _, value = part[1:-1].partition("|")
                spans.append((len(text), len(text) + len(value), kind))
                part = value
            text += part
        rows.append((text, spans))
    return rows


def _plausible(kind: str, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        name, sign, host = text.partition("@")
        return bool(name and sign and host) and "@" not in host
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans and those that the model adds."""
    out, runs, owner = [], [], []
    for i, text in enumerate(texts):
        base = base_matches(text)
        out.append(([s for s, good in base if good], []))
        if _MARK.search(text):
            for places, feats in sequences(text):
                owner.append((i, places, base))
                runs.append(feats)
    for (i, places, base), labels in zip(owner, model.decode(runs)):
        for a, b, kind in _spans(places, labels):
            while b > a and texts[i][b - 1] in ".,;:!?'\"<>[]{}":
                b -= 1
            while a < b and texts[i][a] in ",;:!?'\"<>[]{}":
                a += 1
            free = all(b <= s[0] or s[1] <= a for s, good in base if good or _bars(s, kind, texts[i]))
            if free and _plausible(kind, texts[i][a:b]):
                out[i][1].append((a, b, kind))
    return out


def _bars(failed: Span, kind: str, text: str) -> bool:
    """Does a failed match of a base pattern speak against a span of this kind over it?"""
    a, b, of = failed
    return of == kind or (of == "card" and len(_NOT_DIGIT.sub("", text[a:b])) >= 14)


def _spans(places: list[tuple[int, int]], labels: np.ndarray) -> list[Span]:
    spans: list[Span] = []
    before = 0
    for (a, b), label in zip(places, labels.tolist()):
        if label:
            kind = KINDS[(label - 1) // 2]
            if label % 2 == 0 and before and KINDS[(before - 1) // 2] == kind:
                spans[-1] = (spans[-1][0], b, kind)
            else:
                spans.append((a, b, kind))
        before = label
    return spans


def train(labelled: DataFrame | None = None) -> Model:
    """A model from a table ``(text, spans)`` with spans as ``kind:start:end,...``."""
    if labelled is None:
        return Model.train(default_rows())
    taken = labelled.select("text", "spans").limit(MAX_ROWS + 1).collect()
    if len(taken) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} labelled rows")
    rows = []
    for text, spans in taken:
        parts = [s.split(":") for s in (spans or "").split(",") if s]
        rows.append((text or "", [(int(a), int(b), kind) for kind, a, b in parts]))
    return Model.train(sorted(rows))


def personal_data(
    docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: counts of base spans, ``base_spans``, and ``spans`` with the model's."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model or train())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                found = find([t or "" for t in part.column(text_col).to_pylist()], sent.value)
                counts = {
                    f"n_{k}": pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64())
                    for k in KINDS
                }
                yield add_columns(
                    part,
                    [id_col],
                    **counts,
                    base_spans=pa.array([joined(base) for base, _ in found], pa.string()),
                    spans=pa.array([joined(base + more) for base, more in found], pa.string()),
                )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"`{id_col}` {kind}, {counts}, base_spans string, spans string"
    return docs.select(id_col, text_col).mapInArrow(kernel, schema)


def mask(docs: DataFrame, model: Model | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with ``<KIND>`` in place of personal data; all columns stay.

    Overlapping spans become one mark, of the kind that begins first.  ``size_col``, if there
    is one, is set anew for the texts that change.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model or train())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                texts = part.column(text_col).to_pylist()
                sizes = part.column(size_col).to_pylist() if size_col in part.schema.names else None
                for i, (base, more) in enumerate(find([t or "" for t in texts], sent.value)):
                    if base or more:
                        texts[i] = masked(texts[i], base + more)
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                columns = dict(zip(part.schema.names, part.columns))
                columns[text_col] = pa.array(texts, part.schema.field(text_col).type)
                if sizes is not None:
                    columns[size_col] = pa.array(sizes, part.schema.field(size_col).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(kernel, docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
