"""Training with distance bounds against a search through all centroids."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecprune.operators import bounds
from vecprune.operators.kmeans import first_centroids, fit_kmeans, lloyd, searched_rounds
from vecprune.operators.kernels import unit_rows


def moving(seed: int, spherical: bool, ties: bool):
    """Vectors and centroids that move for a few rounds."""
    rng = np.random.default_rng(seed)
    d, k = rng.integers(2, 12), rng.integers(1, 45)
    x, c = rng.standard_normal((200, d)), rng.standard_normal((k, d))
    if ties:
        x, c = np.round(x), np.round(c)
    if spherical:
        x, c = unit_rows(x[np.abs(x).sum(axis=1) > 0]), unit_rows(c)
    steps = [c]
    for _ in range(5):
        c = c + 0.05 * rng.standard_normal(c.shape) * (rng.random((k, 1)) < 0.5)
        steps.append(unit_rows(c) if spherical else c)
    if spherical:
        steps[2][0] = 0.0  # a mean that cancels out
    return x, steps


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), spherical=st.booleans(), ties=st.booleans())
def test_bounded_search_is_exact(seed, spherical, ties):
    x, steps = moving(seed, spherical, ties)
    groups = bounds.grouped(steps[0])
    base = bounds.Centroids(np.arange(len(steps[0])), steps[0], spherical, groups)
    own, far, _ = bounds.search(x, base, None, None, None)
    for n, c in enumerate(steps[1:]):
        cents = bounds.Centroids(np.arange(len(c)), c, spherical, groups)
        closeness = x @ c.T - cents.half_norms
        best = np.argmax(closeness >= closeness.max(axis=1, keepdims=True) - bounds.TIE, axis=1)
        pick, new, made = bounds.search(x, cents, own, bounds._rounded_down(far).astype(float), cents.moved(base))
        assert (pick == best).all()
        assert made <= len(x) * (len(c) + 1)
        size = 1.0 if spherical else 0.5 * (x * x).sum(axis=1, keepdims=True)
        distance = np.sqrt(np.maximum(2 * (size - closeness), 0))
        distance[np.arange(len(x)), pick] = np.inf
        for g, members in enumerate(groups):
            assert (new[:, g] <= distance[:, members].min(axis=1) + 1e-7).all()
        if n % 2:
            own, far, base = pick, new, cents


def table(df):
    rows = sorted((r.cluster_id, list(r.centroid)) for r in df.collect())
    return [i for i, _ in rows], np.array([c for _, c in rows])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 8))
    rows = [(i, (centers[i % 12] + 0.2 * rng.standard_normal(8)).tolist()) for i in range(3000)]
    rows += [(9000, [0.0] * 8), (9001, [0.0] * 8)]
    return spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("spherical", [True, False])
def test_every_round_equals_the_full_search(vectors, spherical):
    init = first_centroids(vectors, 40, 7, spherical)
    report = []
    for niter in (1, 2, 6):
        rounds = []
        ids, got = table(lloyd(vectors, init, niter, spherical, report=rounds.append))
        plain_ids, want = table(searched_rounds(vectors, init, niter, spherical))
        assert ids == plain_ids
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
        assert [r.number for r in rounds] == list(range(1, niter + 1))
        report = rounds
    assert report[-1].made < report[-1].products / 2
    # Beyond the limit of a broadcast there are no bounds, but the same centroids.
    _, blocks = table(lloyd(vectors, init, 2, spherical, limit_bytes=900))
    np.testing.assert_allclose(blocks, table(searched_rounds(vectors, init, 2, spherical))[1], rtol=1e-9, atol=1e-12)


def test_unjoined_centroids_stay_as_given(spark):
    items = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(20)], "item_id long, embedding array<double>")
    init = spark.createDataFrame([(3, [1.0, 0.0]), (8, [-5.0, 0.0])], "cluster_id int, centroid array<double>")
    ids, got = table(lloyd(items, init, 4))
    assert ids == [3, 8] and got[1].tolist() == [-5.0, 0.0]


def test_empty_tables_train_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, embedding array<float>")
    for spherical in (True, False):
        cents = fit_kmeans(empty, 4, 3, spherical=spherical)
        assert cents.columns == ["cluster_id", "centroid"] and cents.count() == 0
    only_zero = spark.createDataFrame([(1, [0.0, 0.0])], "item_id long, embedding array<float>")
    assert fit_kmeans(only_zero, 4, 3).count() == 0
    some = spark.createDataFrame([(0, [1.0, 0.0])], "cluster_id int, centroid array<double>")
    assert lloyd(empty, some, 3).agg(F.first("centroid")).first()[0] == [1.0, 0.0]
