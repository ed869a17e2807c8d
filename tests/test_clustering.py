"""Trained clusters have no exact twin in SQL, so their properties are checked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecprune.operators.assign import assign, dist_to_centroid, join_centroids
from vecprune.operators.encode import embed, hash_encoder
from vecprune.operators.gather import attach_embeddings, attach_keys
from vecprune.operators.kmeans import first_centroids, fit_kmeans, lloyd, mean_centroids
from vecprune.options import DedupOptions
from vecprune.plans.dedup import cluster_items, dedup, dedup_given_clusters
from vecprune.plans.reports import cluster_report, prune_report
from vecprune.operators.rank import order_policy, rank_within_cluster

DOCS = "/root/testdata/sf0.001/documents.parquet"
VECS = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(VECS).select(F.col("vec_id").alias("item_id"), "embedding").cache()


@pytest.mark.parametrize("spherical", [True, False])
def test_every_item_is_at_its_nearest_centroid(vectors, spherical):
    cents = fit_kmeans(vectors, 7, 10, 3, spherical)
    again = fit_kmeans(vectors, 7, 10, 3, spherical)
    assert sorted(map(tuple, cents.collect())) == sorted(map(tuple, again.collect()))
    metric = "cosine" if spherical else "l2"
    found = {r.item_id: r for r in assign(vectors, cents, metric).collect()}
    c = np.array([r.centroid for r in cents.orderBy("cluster_id").collect()])
    if spherical:
        assert np.allclose(np.linalg.norm(c, axis=1), 1)
    rows = vectors.collect()
    assert len(found) == len(rows)
    for r in rows:
        x = np.array(r.embedding, dtype=float)
        if spherical:
            closeness = c @ (x / np.linalg.norm(x))
            best = closeness.max()
        else:
            closeness = -((c - x) ** 2).sum(axis=1)
            best = -closeness.max()
        assert found[r.item_id].cluster_id == closeness.argmax()
        assert found[r.item_id].score == pytest.approx(best, abs=1e-9)


def test_zero_vectors_do_not_break_training(spark):
    rows = [(i, [0.0, 0.0] if i < 3 else [1.0, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    found = cluster_items(df, DedupOptions(k=2, niter=3))
    assert found.count() == 12


def test_empty_cluster_keeps_its_centroid(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    init = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "cluster_id int, centroid array<double>")
    moved = {r.cluster_id: r.centroid for r in lloyd(df, init, 2).collect()}
    assert moved[1] == [-1.0, 0.0]
    assert moved[0][1] > 0


def test_lloyd_lowers_the_distance(vectors):
    labelled = vectors.withColumn("cluster_id", (F.col("item_id") % 5).cast("int"))
    init = mean_centroids(labelled, spherical=False)
    cost = [
        assign(vectors, lloyd(vectors, init, n, spherical=False), "l2").agg(F.sum("score")).first()[0]
        for n in (0, 1, 3)
    ]
    assert cost[0] > cost[1] > cost[2]


def test_whole_job_keeps_one_of_each_copy(spark):
    docs = spark.read.parquet(DOCS)
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    options = DedupOptions(k=4, niter=5, eps_list=(0.001, 0.05))
    kept = dedup(twice, options, id_col="doc_id", eps=0.001).rows.select("doc_id", "text")
    texts = [r.text for r in kept.collect()]
    assert 0 < len(texts) <= docs.select("text").distinct().count()
    assert len(texts) == len(set(texts))
    fewer = dedup(twice, options, id_col="doc_id", eps=0.05).rows
    assert fewer.count() <= len(texts)


@pytest.mark.parametrize("which", ["easy", "random"])
def test_whole_job_with_parts_and_an_encoder(spark, which):
    docs = spark.read.parquet(DOCS)

    def make_encoder():
        return lambda texts: np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], dtype=float)

    options = DedupOptions(
        k=3, niter=3, eps_list=(0.0001,), which=which, max_cluster_size=16, block=8, spherical=False, metric="l2"
    )
    kept = dedup(docs, options, id_col="doc_id", make_encoder=make_encoder).rows
    assert 0 < kept.count() < docs.count()


def test_encoder_must_return_one_vector_per_item(spark):
    docs = spark.read.parquet(DOCS)
    with pytest.raises(Exception, match="one vector per item"):
        embed(docs, "doc_id", "text", lambda: lambda texts: np.ones((1, 2))).collect()


def test_hash_encoder_edges(spark):
    texts = spark.createDataFrame(
        [(0, None), (1, ""), (2, " \t\n"), (3, "A a b"), (4, "a a b")], "i int, text string"
    )
    got = {r.i: r.embedding for r in hash_encoder(texts, dim=16).collect()}
    assert got[0] == got[1] == got[2] == [0.0] * 16
    assert got[3] == got[4] and sum(x * x for x in got[3]) == pytest.approx(1.0)
    counts = {r.i: r.embedding for r in hash_encoder(texts, dim=16, normalize=False).collect()}
    assert sum(counts[3]) == 2.0


def test_reports(vectors):
    found = cluster_items(vectors, DedupOptions(k=6, niter=5))
    report = cluster_report(found)
    assert report["summary"].first().n_clusters == found.agg(F.max("cluster_id") + 1).first()[0]
    assert report["histogram"].count() == 11
    assert report["clusters"].agg(F.sum("cluster_size")).first()[0] == 500
    ordered = order_policy(rank_within_cluster(found), "hard")
    pruning = prune_report(ordered, [0.5, 0.7], block=32)
    assert pruning["items"].count() == 500
    assert pruning["sweep"].count() == 2
    removed = pruning["eps_report"].where("eps = 0.7").agg(F.sum("num_duplicates")).first()[0]
    assert removed == pruning["items"].where("eps_0_7").count()


def test_bad_vectors_stop_the_kernels(spark):
    cents = spark.createDataFrame([(0, [1.0, 0.0])], "cluster_id int, centroid array<double>")
    for bad in (None, [1.0], [float("nan"), 1.0]):
        rows = [(0, [1.0, 2.0]), (1, bad), (2, [0.5, 1.0])]
        df = spark.createDataFrame(rows, "item_id long, embedding array<float>").coalesce(1)
        with pytest.raises(Exception, match="split_valid"):
            assign(df, cents).collect()


@pytest.mark.parametrize("copies", [0, 400])
def test_training_starts_from_different_vectors(spark, copies):
    """Copies don't count twice, however many of the lowest hashes they have."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(40)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(copies)] + [(5000, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)
    for k in (5, 40, 60):
        starts = first_centroids(df, k, 3).collect()
        different = 40 + (copies > 0)
        assert sorted(r.cluster_id for r in starts) == list(range(min(k, different)))
        assert len({tuple(np.round(r.centroid, 9)) for r in starts}) == min(k, different)
    some = {r.cluster_id: tuple(r.centroid) for r in first_centroids(df, 5, 3).collect()}
    more = {r.cluster_id: tuple(r.centroid) for r in first_centroids(df, 40, 3).collect()}
    assert all(more[i] == some[i] for i in some)


def test_cosine_cannot_be_derived_from_plain_scores(vectors):
    cents = fit_kmeans(vectors, 4, 2, 1, spherical=False)
    with pytest.raises(ValueError, match="cosine"):
        dist_to_centroid(assign(vectors, cents, "l2"), None, "cosine", spherical=False)


def test_blocks_of_centroids_agree_with_one(vectors):
    cents = fit_kmeans(vectors, 9, 2, 1, spherical=False)
    for metric in ("cosine", "ip", "l2"):
        whole = {r.item_id: (r.cluster_id, round(r.score, 9)) for r in assign(vectors, cents, metric).collect()}
        parts = assign(vectors, cents, metric, limit_bytes=1100)
        assert {r.item_id: (r.cluster_id, round(r.score, 9)) for r in parts.collect()} == whole


def test_bad_rows_do_not_end_a_job(spark):
    good = [(i, 0, [float(i % 3), 1.0, 0.0]) for i in range(12)]
    bad = [(20, 0, None), (21, 0, [1.0]), (22, 0, [float("nan"), 1.0, 0.0]), (23, None, [1.0, 0.0, 0.0])]
    # The malformed row comes first.
    df = spark.createDataFrame(bad[1:2] + good + bad, "item_id long, cluster_id int, embedding array<float>").coalesce(1)
    rows, rejects = dedup_given_clusters(df, DedupOptions(eps_list=(0.01,)))
    assert sorted(r.item_id for r in rows.collect()) == list(range(12))
    reasons = {r.item_id: r.reason for r in rejects.collect()}
    assert reasons == {20: "null", 21: "dimension", 22: "not finite", 23: "no cluster"}
    ordered = df.withColumns({"dist": F.lit(0.5), "order_pos": F.col("item_id") + 1})
    report = prune_report(ordered, [0.5])
    assert report["items"].count() == 13 and report["rejects"].count() == 4
    odd = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "item_id long, text string")

    def make_encoder():
        return lambda texts: np.array([[np.nan if t is None else len(t), 1.0] for t in texts])

    kept, rejects = dedup(odd, DedupOptions(k=2, niter=1), make_encoder=make_encoder)
    assert {r.item_id for r in kept.collect()} == {1, 3} and [r.item_id for r in rejects.collect()] == [2]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_cluster_keys_of_other_types(spark, kind):
    names = ["enx", "eny", None] if kind == "string" else [5_000_000_000, 5_000_000_000 + 2**32, None]
    rows = [(i, names[i % 3], [1.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, f"item_id long, k {kind}, embedding array<float>")
    out, rejects = dedup_given_clusters(df, DedupOptions(eps_list=(0.01,)), cluster_col="k")
    found = {r.item_id: (r.cluster_id, r.eps_0_01) for r in out.collect()}
    assert {found[i][0] for i in (0, 3, 6)} == {0} and {found[i][0] for i in (1, 4, 7)} == {1}
    assert sorted(i for i in found if not found[i][1]) == [0, 1]
    assert {r.item_id for r in rejects.collect()} == {2, 5, 8}


def test_joins_lose_nothing_silently(spark):
    members = spark.createDataFrame([(1, 0), (2, 1)], "item_id long, cluster_id int")
    vectors = spark.createDataFrame([(1, [1.0])], "item_id long, embedding array<float>")
    with pytest.raises(Exception, match="no vector"):
        attach_embeddings(members, vectors).collect()
    keys = members.where("item_id = 1").withColumn("path", F.lit("x"))
    with pytest.raises(Exception, match="no key"):
        attach_keys(members, keys).collect()
    cents = spark.createDataFrame([(0, [1.0])], "cluster_id int, centroid array<double>")
    for limit in (0, 1 << 20):
        with pytest.raises(Exception, match="no centroid"):
            join_centroids(members, cents, limit_bytes=limit).collect()


def test_ranks_are_the_same_at_every_scale(spark):
    rows = [(i, 0, d) for i, d in enumerate([1e-12, 5e-11, 3e-10, 0.25, 0.25 + 1e-15, 0.0])]
    df = spark.createDataFrame(rows, "item_id long, cluster_id int, dist double")
    for hot in (1, 1000):
        pos = {r.item_id: r.pos for r in rank_within_cluster(df, hot_rows=hot).collect()}
        assert pos == {3: 1, 4: 2, 2: 3, 1: 4, 0: 5, 5: 6}


def test_a_scope_drops_its_stage_tables(spark):
    from vecprune.staging import stage_scope, stage_table, table_exists

    outer = stage_table(spark.range(3), "outer")
    with stage_scope(spark):
        inner = stage_table(spark.range(3), "inner")
        assert inner.count() == 3
    assert table_exists(spark, outer.stage_path) and not table_exists(spark, inner.stage_path)


def test_stage_tables_can_be_dropped(spark):
    from vecprune.staging import drop_stages, stage_table, table_exists

    staged = stage_table(spark.range(3), "drop")
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    assert table_exists(spark, folder)
    drop_stages(spark)
    assert not table_exists(spark, folder)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_search_is_exact_among_close_centroids(spark, metric, scale):
    """Centroids that single precision cannot tell apart."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(4, 12))
    cents = np.concatenate([base, base + 1e-8 * rng.normal(size=(4, 12)), base[:2]]) * scale
    table = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(cents)], "cluster_id int, centroid array<double>"
    )
    x = rng.normal(size=(200, 12)).astype(np.float32)
    rows = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>"
    )
    got = {r.item_id: r.cluster_id for r in assign(rows, table, metric).collect()}
    x = x.astype(np.float64)
    if metric == "cosine":
        x /= np.linalg.norm(x, axis=1)[:, None]
        cents = cents / np.linalg.norm(cents, axis=1)[:, None]
    closeness = x @ cents.T - (0.5 * (cents**2).sum(axis=1) if metric == "l2" else 0)
    for i, row in enumerate(closeness):
        # Equal up to double rounding counts as a tie.
        assert row[got[i]] >= row.max() - 1e-9
        assert got[i] < 8


def test_items_need_a_centroid(items, spark):
    from vecprune.operators.assign import dist_to_centroid

    cents = spark.createDataFrame([(0, [1.0, 0.0])], "cluster_id int, centroid array<double>")
    rows = items([(0, 0, [1.0, 0.0]), (1, 5, [1.0, 0.0])])
    for limit in (0, 1 << 20):
        with pytest.raises(Exception, match="has no centroid"):
            dist_to_centroid(rows, cents, limit_bytes=limit).collect()
