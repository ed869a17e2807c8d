"""The operators' own interfaces: other parameters, split hot groups, models, real outputs."""

import random

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import compare
from vecprune.llm import anchors, attention, decontaminate, langid, lm, pii, quotes, repeats, simhash, suffix, text
from vecprune.llm.bpe import Encoder, UnreachableToken, decode_ids, encode_documents, read_ranks
from vecprune.llm.components import components
from vecprune.llm.grouped import group_batches
from vecprune.llm.repetition import OP1_SQL, keep_unrepetitive, op1_repetition

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


# -- words and hashes ------------------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abé \t\n\x0b\x1c ", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    found = text.Words(pa.array(texts, pa.string()))
    want = [brute.words(t) for t in texts]
    assert found.count.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert found.chars().tolist() == [len(w) for w in flat]
    assert len(set(found.hash.tolist())) == len(set(flat))


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (0, 5, 50, 0, 7, 3)] + [None]})
    parts = list(text.chunks(batch, "t", limit=8))
    assert sum((p.column("t").to_pylist() for p in parts), []) == batch.column("t").to_pylist()
    assert len(parts) > 1


def test_repetition_sql(spark):
    assert compare.differences(op1_repetition(spark, SF), compare.duck(SF), OP1_SQL) == []


def test_rejected_documents_go(spark, hard_dir):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    kept = keep_unrepetitive(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {5, 6, 8} <= ids and not ids & {0, 1, 3, 12, 13}


@pytest.mark.parametrize("limit", [0, 1, 5, 20])
def test_groups_stay_whole(limit):
    """Groups cut by batches come out whole, in order, and in tables of about the limit."""
    rng = np.random.default_rng(limit)
    for _ in range(40):
        sizes = rng.integers(1, 9, rng.integers(1, 30))
        keys = np.repeat(np.arange(len(sizes)), sizes)
        edges = [0, *np.sort(rng.integers(0, len(keys) + 1, 4)), len(keys)]
        batches = [
            pa.RecordBatch.from_pydict({"k": keys[a:b], "v": np.arange(a, b)}) for a, b in zip(edges, edges[1:])
        ]
        out = list(group_batches(iter(batches), ["k"], limit))
        assert [v for t, _ in out for v in t.column("v").to_pylist()] == list(range(len(keys)))
        assert sum(len(s) for _, s in out) == len(sizes)
        assert all(len(set(t.column("k").to_pylist())) == len(s) for t, s in out)
        assert not limit or all(t.num_rows <= limit + 8 for t, _ in out)


# -- near-duplicates ---------------------------------------------------------------------------


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(3)
    names = [rng.getrandbits(63) - (1 << 62) for _ in range(400)]
    chain = [(names[i], names[i + 1]) for i in range(199)]
    star = [(names[200], names[i]) for i in range(201, 400)]
    links = spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long")
    found = {r.node: r.label for r in components(links).collect()}
    assert len({found[n] for n in names[:200]}) == 1 and len({found[n] for n in names[200:]}) == 1
    assert len(set(found.values())) == 2


@pytest.mark.parametrize("block", [3, 4096])
def test_links_of_dense_groups(spark, block):
    rng = random.Random(4)
    centers = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centers for _ in range(40)}
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    nodes = spark.createDataFrame(rows, "print long").selectExpr("print", "xxhash64(print) AS node")
    links = simhash.near_links(nodes, block)
    assert links.count() < 16 * len(prints) * (80 if block == 3 else 1)
    labels = {r.node: r.label for r in components(links).collect()}
    of = {r.print % (1 << 64): labels.get(r.node, r.node) for r in nodes.collect()}
    want = brute.components(list(prints))
    groups, mine = {}, {}
    for p in prints:
        groups.setdefault(want[p], set()).add(p)
        mine.setdefault(of[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_one_of_each_stays(spark, hard_dir, hard):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [brute.fingerprint(t) for _, t, *_ in hard]
    parts = brute.components(prints)
    groups = {}
    for (i, *_), p in zip(hard, prints):
        groups.setdefault(parts[p], []).append(i)
    want = [min((i is None, i or 0, i) for i in g)[2] for g in groups.values()]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


# -- exact repeats -----------------------------------------------------------------------------


def _docs(spark):
    rng = random.Random(6)
    shared = [prose(50 + k, 60) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + 10 * i + j, rng.randint(3, 25)) for j in range(4)]
        for k in rng.sample(range(4), rng.randint(0, 3)):
            cut = rng.randint(0, 200)
            parts.insert(rng.randint(0, 4), shared[k][cut : cut + rng.randint(60, 400)])
        rows.append((i, " ".join(parts) if i % 7 else parts[0] * 3))
    rows += [(70, rows[1][1]), (71, rows[1][1]), (71, rows[1][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [8192, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_small_windows(spark, hot, keep_first):
    """Other windows, both policies, and owners too hot for one task."""
    rows, docs = _docs(spark)
    rows = sorted(rows)
    plain = brute.later if keep_first else brute.repeated
    for module, window, gram, split in (
        (suffix, 40, 12, lambda t: t.encode()),
        (anchors, 9, 3, lambda t: tuple(t.encode().split())),
    ):
        want = plain([split(t) for _, t in rows], window)
        found = module.removals(docs, window=window, gram=gram, keep_first=keep_first, hot=hot).collect()
        got = {}
        for r in found:
            gone = [False] * len(split(r.text))
            for a, b in repeats.merged(r.spans):
                gone[a:b] = [True] * (b - a)
            got.setdefault(r.id, []).append(gone)
        assert sum(map(len, got.values())) == len(rows)
        for (i, _), gone in zip(rows, want):
            if i < 71 or not keep_first:
                assert got[i][0] == gone, (module.__name__, i)


def test_window_minimum():
    keys = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for width in (1, 2, 7, 100):
        want = [keys[i : i + width].min() for i in range(100 - width + 1)]
        assert repeats.window_minimum(keys, width).tolist() == want


# -- language ----------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.in_fold("doc_id", 4, 2)
    found = langid.predict(docs.filter(held), langid.fit(docs.filter(~held)))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_families_and_pairs():
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((4, langid.DIM)).astype(np.float32)
    lang = np.repeat(["de", "en", "es", "fr"], 30)
    x = centers[np.repeat(np.arange(4), 30)] + 0.3 * rng.standard_normal((120, langid.DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Classifier.fit(x, lang)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    best, score = model.predict(x)
    assert (np.array(model.langs)[best] == lang).all() and ((0 <= score) & (score <= 1)).all()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, None).collect()] == [("und", 0.0)]


# -- personal data -----------------------------------------------------------------------------


@given(st.text(alphabet="aZ@.1234 56+-()é%\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_patterns(value):
    got = pii.joined(s for s, good in pii.base_matches(value) if good)
    assert got == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(value))


def test_model_on_unseen_rows():
    model = pii.train()
    unseen = [
        ("please ring 312-555-7788 soon", ["312-555-7788"]),
        ("tel. (646) 555-3322.", ["(646) 555-3322"]),
        ("write to bob@printer7 or wait", ["bob@printer7"]),
        ("in the year 2021 with 14 people", []),
        ("version 4.1 of 2019-07-14", []),
        ("password=91be7ab4a5fcc78305 was set", []),
    ]
    for value, want in unseen:
        _, more = pii.find([value], model)[0]
        assert [value[a:b] for a, b, _ in more] == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    model = pii.Model(rng.standard_normal((pii.FEATURES, pii.N_LABELS)), rng.standard_normal((pii.N_LABELS,) * 2))
    runs = [rng.integers(0, pii.FEATURES, (n, 3)).tolist() for n in (1, 2, 3, 3, 1)]
    for run, labels in zip(runs, model.decode(runs)):
        unary = model.weights[np.array(run)].sum(axis=1)

        def value(path):
            steps = zip([0, *path], [*path, 0])
            return unary[np.arange(len(path)), path].sum() + sum(model.moves[a, b] for a, b in steps)

        best = max(value(p) for p in np.ndindex(*(pii.N_LABELS,) * len(run)))
        assert abs(value(tuple(labels)) - best) < 1e-9


def test_masking(spark):
    rows = [(1, "a.b@c.de or 1.2.3.4!", 20, "x"), (2, None, None, "y"), (3, "clean", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted(pii.mask(docs).collect())
    assert [tuple(r) for r in got] == [(1, "<EMAIL> or <IP>!", 16, "x"), (2, None, None, "y"), (3, "clean", 5, "z")]


# -- benchmark ---------------------------------------------------------------------------------


def test_edited_passages_are_found():
    items = [(k, prose(200 + k, 70)) for k in range(20)]
    search = decontaminate.Search(decontaminate.cut(items))
    rng = random.Random(7)
    for k, (_, value) in enumerate(items):
        chars = list(decontaminate.normalised(value))
        for _ in range(len(chars) * 3 // 100):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "q"]])
        half = "".join(chars)[: max(160, len(chars) // 2)]
        docs = [decontaminate.normalised(t) for t in (prose(300 + k, 60), f"{prose(400 + k, 30)} {half} {prose(500 + k, 30)}")]
        found, piece, edits, _ = search.hits(docs)
        assert set(found.tolist()) == {1}
        assert set(search.pieces.item[piece].tolist()) == {k}


def test_alignment_is_the_edit_distance():
    rng = random.Random(8)
    for _ in range(30):
        value = decontaminate.normalised(prose(rng.randrange(10**6), 25))[:90]
        chars = list(value)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "q"]])
        doc = "xx yy " + "".join(chars) + " zz"
        row = [0] * (len(doc) + 1)
        for i, c in enumerate(value):
            new = [i + 1]
            for j, d in enumerate(doc):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        _, _, edits, _ = decontaminate.Search(decontaminate.cut([(0, value)])).hits([doc])
        bound = len(value) * decontaminate.EDIT_PERCENT // 100
        assert (min(row) > bound and not len(edits)) or set(edits.tolist()) == {min(row)}


# -- BPE ---------------------------------------------------------------------------------------


@given(st.text(alphabet="ab the in\n\t.,1é中\U0001f600", max_size=200))
@settings(max_examples=200, deadline=None)
def test_joins_equal_the_plain_encoding(value):
    coder, plain = _coders()
    data = value.encode()
    for cut in {0, len(data) // 3, len(data)}:
        whole = coder.join(coder.encode(data[:cut]), coder.encode(data[cut:]))
        assert whole == coder._merge(data) == coder._merge_long(data)
    ids = np.frombuffer(coder.encode_text(value), "<u4").tolist()
    assert ids == plain.encode_ordinary(value)
    assert coder.decode(coder.encode_text(value)) == data


_made = []


def _coders():
    if not _made:
        ranks = Encoder.parse(read_ranks(RANKS))
        pattern = public_tokenizers.PATTERN
        _made.append(Encoder(ranks, pattern))
        _made.append(tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    return _made


def test_unreachable_tokens_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    with pytest.raises(UnreachableToken):
        Encoder(ranks, "").check()


def test_ids_and_texts_round_trip(spark, hard_dir, hard):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    back = decode_ids(encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t, *_ in hard)


# -- language model ----------------------------------------------------------------------------


def _model():
    counts = np.random.default_rng(1).integers(1, 100, attention.SLOTS).astype(float)
    return attention.initial(counts)


def test_probabilities_add_up_and_look_back_only():
    scorer, rng = attention.Scorer(_model()), np.random.default_rng(2)
    row = rng.integers(0, attention.SLOTS, attention.LENGTH + 1)
    rows = np.repeat(row[None], attention.SLOTS, axis=0)
    rows[:, -1] = np.arange(attention.SLOTS)
    last = scorer.score(rows[:, :-1], rows[:, 1:])
    assert abs(np.exp(last[:, -1].astype(float)).sum() - 1) < 1e-4
    changed, at = row.copy(), attention.LENGTH // 2
    changed[at] = (changed[at] + 1) % attention.SLOTS
    a, b = (scorer.score(r[None, :-1], r[None, 1:])[0] for r in (row, changed))
    assert np.allclose(a[: at - 1], b[: at - 1]) and not np.allclose(a[at:], b[at:])


def test_slopes_and_descent():
    params, rng = _model(), np.random.default_rng(3)
    windows = rng.integers(0, 40, (256, 1)) + np.arange(attention.LENGTH + 1) % 3
    weight = np.ones((256, attention.LENGTH), np.float32)

    def loss(p):
        return -float(attention.Scorer(p).score(windows[:, :-1], windows[:, 1:]).astype(float).mean())

    slopes = attention.slopes(params, windows[:, :-1], windows[:, 1:], weight)
    for name in ("embed", "key", "value", "bias", "mix", "high", "low_bias"):
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
        up[name][at] += 0.02
        down[name][at] -= 0.02
        assert abs((loss(up) - loss(down)) / 0.04 - slopes[name][at]) < 0.1 * abs(slopes[name][at]) + 2e-4
    assert loss(attention.descend(params, windows, weight, 0.02, 16)) < loss(params) - 0.3
    assert np.allclose(attention.flat(attention.unflat(attention.flat(params))), attention.flat(params))


def test_every_token_is_scored_once():
    reader = lm.Subwords(read_ranks(RANKS))
    chunk = reader.ids(pa.array([prose(1, 200), None, "one", prose(2, 30)], pa.string()))
    ids, scored = chunk.windows(np.arange(len(chunk.owner)))
    assert scored.sum() == len(chunk.ids)
    assert (ids[:, 1:][scored] == chunk.ids).all()
    assert (chunk.ids[chunk.offsets[1:] - 1] == lm.END).all()


def test_held_out_scores_beat_subword_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.in_fold("doc_id", 5, 1)
    rows = lm.scores(docs.filter(held), docs.filter(~held), RANKS).collect()
    reader = lm.Subwords(read_ranks(RANKS))
    train = [r.text for r in docs.filter(~held).select("text").collect()]
    test = [r.text for r in docs.filter(held).select("text").collect()]
    counts = np.bincount(reader.ids(pa.array(train)).ids, minlength=lm.N_IDS) + 0.5
    ids = reader.ids(pa.array(test)).ids
    plain = np.log10(counts / (counts[: 50_257].sum()))[ids].sum()
    assert sum(r.score for r in rows) > 0.95 * plain


def test_few_frequent_words(spark, hard_dir, hard, monkeypatch):
    """Most words come from the join, not from the broadcast."""
    monkeypatch.setattr(lm, "FREQUENT", 3)
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (3,))
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    got = lm.scores(docs, docs.filter(~langid.in_fold("doc_id", 5, 1)), RANKS).collect()
    want = brute.base_scores([(i, t) for i, t, *_ in hard])
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(
        (n, known, round(score, 6)) for n, known, _, score in want
    )


# -- quotes ------------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "user", "Hello there\nhow are you?\n\nBye"),
    (1, 1, "assistant", "> Hello there\n> how are you?\n\nFine"),
    (1, 2, "user", "other topic"),
    (1, 3, "user", ">> hello   THERE\n>> how are you?\n> Fine\nGood\n> nobody said"),
    (1, 4, "assistant", "> other topic\nyes"),
    (1, 5, "user", " > > > nothing\n> Good\nok"),
    (1, None, "user", "> Good\nok"),
    (None, 3, "user", "> Good\nx"),
    (2, 0, None, None),
    (2, 1, "user", ""),
    (2, 1, "user", "> "),
    (2, 1, "assistant", "> x\n> y"),
    (3, 1, "user", "> self\nself"),
] + [(4, k, "user", f"> message {k - 1} {'é' * k}\nMESSAGE  {k} {'É' * (k + 1)}") for k in range(40)]


def test_quotes(spark):
    messages = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", messages.toArrow())
    found = quotes.link_quotes(messages.selectExpr("*", "1 AS uid", "2 AS level", "'x' AS said"))
    assert compare.differences(found, con, quotes.OP10_SQL) == []
    chain = [r for r in found.collect() if r.conv_id == 4]
    assert len(chain) == 40 and all(">" not in r.said for r in chain)


def test_quotes_run_no_python(spark):
    messages = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    plan = quotes.link_quotes(messages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- repeated rows, long and periodic texts ----------------------------------------------


@pytest.mark.parametrize("module", [suffix, anchors])
def test_repeated_rows_have_their_spans_once(spark, module):
    """Rows with NULL and with equal ids: spans grow with the rows, not with their square."""
    text = prose(50, 450)
    rows = [(None, text)] * 400 + [(3, text)] * 400 + [(None, prose(51, 60)), (4, text + " " + prose(52, 500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = module.removals(docs).select("id", F.size("spans").alias("n"), F.col("spans")).collect()
    assert len(found) == len(rows)
    copies = [r for r in found if (r.n or 0) > 0]
    assert len(copies) == 801 and max(r.n for r in copies) < 200
    size = len(text.encode()) if module is suffix else 450
    assert {repeats.merged([s.asDict() for s in r.spans])[0] for r in copies} == {(0, size)}


@pytest.mark.parametrize("module", [suffix, anchors])
def test_long_texts_are_cut_in_segments(spark, module):
    """Texts far longer than a segment, with repeats across its ends, and one of a single symbol."""
    small = 700
    body = prose(60, 3000)
    rows = [(1, body), (2, prose(61, 20) + " " + body[2000:9000] + prose(62, 90)), (3, "ab " * 3000), (4, "a" * 9000)]
    rows += [(5, "ab " * 2000 + "c"), (6, prose(63, 2000))]
    kind = module.kind()
    data, docs = [t.encode() for _, t in rows], spark.createDataFrame(rows, "doc_id long, text string")
    symbols = [list(d) if module is suffix else d.split() for d in data]
    for (i, _), d, mine in zip(rows, data, symbols):
        at = 0
        starts = max(0, len(mine) - kind.window + 1)
        for piece, before, n in kind.segments(d, small, kind.window):
            inside = list(piece) if module is suffix else piece.split()
            assert before == at and inside == mine[before : before + len(inside)]
            assert len(inside) >= min(n + kind.window - 1, len(mine) - before)
            at += n
        assert at >= starts
    want = brute.repeated([tuple(s) for s in symbols], kind.window)
    got = {r.id: repeats.merged([s.asDict() for s in r.spans or ()]) for r in module.removals(docs).collect()}
    for (i, _), gone in zip(rows, want):
        mine = np.zeros(len(gone), bool)
        for a, b in got[i]:
            mine[a:b] = True
        assert mine.tolist() == gone


@pytest.mark.parametrize("module", [suffix, anchors])
def test_passage_across_a_segment_end(spark, module):
    """A text of several segments that shares one passage with another, where a segment ends."""
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(10**9)}" for _ in range(120)) + " "
    words = [f"{rng.randrange(10**9)}" for _ in range(600_000)]
    body = " ".join(words) + " "
    assert len(body) > 2 * repeats.SEGMENT
    at = body.rindex(" ", 0, repeats.SEGMENT) + 1 - len(passage) // 2
    at = body.index(" ", at) + 1
    rows = [(1, body[:at] + passage + body[at:]), (2, "x " + passage + "y")]
    found = module.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.id: repeats.merged([s.asDict() for s in r.spans]) for r in found}
    if module is anchors:
        before = len(body[:at].split())
        assert got == {1: [(before, before + 120)], 2: [(1, 121)]}
    else:
        # A blank more on the left belongs to both.
        assert got == {1: [(at - 1, at + len(passage))], 2: [(1, 2 + len(passage))]}


def test_one_repeated_byte_makes_few_slices():
    column = pa.array([b"a" * 1_000_000], pa.binary())
    found = repeats.slices(*suffix._symbols(column), suffix.WINDOW, suffix.GRAM)
    assert len(found["n"]) < 1_000_000 / 400 and found["n"].sum() == 1_000_000 - 399
    assert len(set(zip(found["owner"].tolist(), found["content"].tolist()))) <= 2


def test_longest_factors():
    rng = np.random.default_rng(1)
    for t in range(40):
        most, k = int(rng.integers(1, 40)), int(rng.integers(1, 4))
        numbers = rng.integers(0, k, int(rng.integers(most, 120))).astype(np.uint8)
        start = np.arange(len(numbers) - most + 1)[rng.random(len(numbers) - most + 1) < 0.8]
        earlier, further = suffix.longest_factors(numbers, start, most)
        for n, i in enumerate(start):
            best = [0, 0]
            for j in start[start != i]:
                same = numbers[i : i + most] == numbers[j : j + most]
                best[int(j > i)] = max(best[int(j > i)], int(np.argmin(same)) if not same.all() else most)
            assert [earlier[n], further[n]] == best
