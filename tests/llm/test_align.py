"""The alignment against a plain version, with the buffers of production and with tiny ones."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vecprune.llm import align

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
MORE = [
    (50, "a▁b"), (51, "x<|endoftext|> <0x41> <s>"), (52, " lead"), (53, "tab\tnew\r\n\n  two   blanks "),
    (54, "é ﬁ 　 x"), (55, "same words here"), (55, "same words here"), (56, "a" * 5000),
]


def spans(ids, data_of):
    out, at = [], 0
    for n in ids:
        out.append((at, at + len(data_of(n)), n))
        at = out[-1][1]
    return out


def plain(rows):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = align.byte_letters()
    found, counts = [], collections.Counter()

    def a_bytes(n):
        return bytes(letters[c] for c in a.id_to_token(n))

    def b_bytes(n):
        piece = b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(n) else piece.replace("▁", " ").encode()

    for i, text in rows:
        left = spans(a.encode(f" {text}", add_special_tokens=False).ids, a_bytes) if text else []
        right = spans(b.encode(text), b_bytes) if text else []
        for side, data_of in ((left, a_bytes), (right, b_bytes)):
            if b"".join(data_of(n) for *_, n in side) != f" {text}".encode():
                left = right = []
        links, groups = merged(left, right), []
        common = {e for _, e, _ in left} & {e for _, e, _ in right}
        for x, y in zip(cut(left, common), cut(right, common)):
            groups.append(f"{x}|{y}")
        counts.update(links)
        text_sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        found.append((i, len(left), len(right), len(groups), links, text_sha))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return collections.Counter(
        (i, na, nb, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), sha)
        for i, na, nb, g, ls, sha in found
    )


def merged(left, right):
    """Ids of overlapping tokens, walking along both sides."""
    out, j = [], 0
    for p, q, n in left:
        while right[j][1] <= p:
            j += 1
        k = j
        while k < len(right) and right[k][0] < q:
            out.append((n, right[k][2]))
            k += 1
    return out


def cut(side, common):
    """The ids up to each common end."""
    out, held = [], []
    for _, end, n in side:
        held.append(str(n))
        if end in common:
            out.append(",".join(held))
            held = []
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("options", [{}, {"radix": 3, "run_links": 1000, "runs_per_split": 5}])
def test_hard_rows(spark, hard, options):
    rows = [(r[0], r[1]) for r in hard] + MORE
    schema = "doc_id long, text string, row long, part string, n long, kind string, directory long"
    docs = spark.createDataFrame([(*r, 1, "p", 2, "k", 3) for r in rows], schema).repartition(3)
    found, _ = align.alignment(docs, *PATHS, **options)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == plain(rows)


def test_query_on_test_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = align.op13_align(spark, folder).collect()
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == plain(rows)


def test_merge_of_runs():
    rng = np.random.default_rng(3)
    blobs, total = [], collections.Counter()
    for _ in range(9):
        pair = rng.integers(0, 3000, rng.integers(1, 4000)).astype(np.uint32) * np.uint32(1 << 9)
        total.update(pair.tolist())
        runs = align.Runs(1, 1 << 20)
        assert list(runs.add(pair, np.zeros(len(pair), np.int64))) == []
        blobs += [directory for _, _, directory, _ in runs.spill()]
    merged = [(int(k), int(n)) for keys, sums in align.merged_counts(blobs, block=16) for k, n in zip(keys, sums)]
    assert merged == sorted(total.items())


def test_counts_of_pairs(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, None)], "doc_id long, text string")
    _, counts = align.alignment(docs, *PATHS)
    assert {(r.n, r.best) for r in counts.collect()} == {(2, True)}
