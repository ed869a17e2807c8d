"""Block-wise pruning against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecprune.operators.ordinal import ordinal
from vecprune.operators.prune import max_earlier_sim, prune_table, select_pruned
from vecprune.operators.rank import order_policy, rank_within_cluster
from vecprune.operators.stats import extreme_sims, pairwise_std

FEW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def brute_force(vectors, clusters):
    """Largest similarity to an earlier item, in id order inside each cluster."""
    u = vectors.astype(np.float64)
    norms = np.linalg.norm(u, axis=1)
    u = u / np.where(norms == 0, 1, norms)[:, None]
    out = {}
    for c in set(clusters):
        ids = [i for i in range(len(u)) if clusters[i] == c]
        sims = u[ids] @ u[ids].T
        for p, i in enumerate(ids):
            out[i] = max(0.0, sims[p, :p].max()) if p else 0.0
    return out


def table(items, vectors, clusters):
    rows = items([(i, int(clusters[i]), vectors[i].tolist()) for i in range(len(vectors))])
    return ordinal(rows, [F.col("item_id")], ["cluster_id"], "order_pos")


def flooded(n, copies, exact, seed):
    """Random vectors, the first ``copies`` of them (nearly) the same and in one cluster."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, 6)).astype(np.float32)
    noise = 0.0 if exact else 0.001
    vectors[:copies] = vectors[0] + noise * rng.normal(size=(copies, 6))
    clusters = rng.integers(0, 3, size=n)
    clusters[:copies] = 0
    # Spread the copies over the order.
    mix = rng.permutation(n)
    return vectors[mix], clusters[mix]


@FEW
@given(
    n=st.integers(2, 60),
    share=st.floats(0, 1),
    exact=st.booleans(),
    block=st.integers(1, 70),
    seed=st.integers(0, 99),
)
def test_blocks_equal_brute_force(items, n, share, exact, block, seed):
    vectors, clusters = flooded(n, max(1, int(n * share)), exact, seed)
    rows = table(items, vectors, clusters)
    expected = brute_force(vectors, clusters)
    got = {r.item_id: r.max_earlier_sim for r in max_earlier_sim(rows, block=block).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("block", [7, 64])
def test_flood_of_copies(items, exact, block):
    """A third of all rows are copies in one cluster, far more than a block."""
    vectors, clusters = flooded(600, 200, exact, 5)
    rows = table(items, vectors, clusters)
    expected = brute_force(vectors, clusters)
    eps_list = [0.01, 0.1, 0.4]
    pruned = prune_table(rows, eps_list, block=block).collect()
    assert len(pruned) == 600
    for r in pruned:
        for eps, name in zip(eps_list, ["eps_0_01", "eps_0_1", "eps_0_4"]):
            assert r[name] == (expected[r.item_id] > 1 - eps)


def test_parts_that_span_blocks(items):
    """Groups that start in the middle of a cluster's order."""
    vectors, _ = flooded(120, 30, False, 3)
    rows = table(items, vectors, np.zeros(120, dtype=int))
    rows = rows.withColumn("part", F.expr("(order_pos - 1) div 50"))
    got = {
        r.item_id: r.max_earlier_sim
        for r in max_earlier_sim(rows, keys=["cluster_id", "part"], block=8).collect()
    }
    assert got == pytest.approx(brute_force(vectors, [i // 50 for i in range(120)]), abs=1e-9)


def test_more_eps_removes_more_and_first_is_kept(items):
    vectors, clusters = flooded(90, 30, False, 1)
    eps_list = [0.05, 0.2, 0.5, 0.9]
    pruned = prune_table(table(items, vectors, clusters), eps_list, block=16).cache()
    removed = [
        {r.item_id for r in select_pruned(pruned, e, kept=False).collect()} for e in eps_list
    ]
    kept = [{r.item_id for r in select_pruned(pruned, e).collect()} for e in eps_list]
    for smaller, larger in zip(removed, removed[1:]):
        assert smaller <= larger
    for k, r in zip(kept, removed):
        assert k | r == set(range(90)) and not k & r
    firsts = {r.item_id for r in pruned.where("order_pos = 1").collect()}
    assert all(firsts <= k for k in kept)


def test_partitioning_does_not_matter(items):
    vectors, clusters = flooded(80, 20, False, 2)
    rows = table(items, vectors, clusters)
    one = max_earlier_sim(rows.coalesce(1), block=16).collect()
    many = max_earlier_sim(rows.repartition(7), block=16).collect()
    assert {r.item_id: round(r.max_earlier_sim, 12) for r in one} == {
        r.item_id: round(r.max_earlier_sim, 12) for r in many
    }


@pytest.mark.parametrize("hot_rows", [1, 10**6])
def test_order_of_a_hot_cluster(items, hot_rows):
    """Positions from the range sort equal those of the window, also among equal distances."""
    rng = np.random.default_rng(0)
    dist = rng.integers(0, 4, size=300) / 4
    cluster = np.where(rng.random(300) < 0.6, 0, rng.integers(1, 5, size=300))
    rows = items([(i, int(cluster[i]), [1.0], float(dist[i])) for i in range(300)]).repartition(5)
    ranked = rank_within_cluster(rows, hot_rows=hot_rows)
    got = {(r.cluster_id, r.pos): r.item_id for r in ranked.collect()}
    for c in range(5):
        ids = sorted((i for i in range(300) if cluster[i] == c), key=lambda i: (-dist[i], i))
        assert [got[c, p + 1] for p in range(len(ids))] == ids
    shuffled = order_policy(ranked, "random", 7, hot_rows=hot_rows)
    order = {r.item_id: r.order_pos for r in shuffled.collect()}
    again = {
        r.item_id: r.order_pos
        for r in order_policy(ranked.repartition(3), "random", 7, hot_rows=hot_rows).collect()
    }
    assert order == again
    for c in range(5):
        assert sorted(order[i] for i in range(300) if cluster[i] == c) == list(
            range(1, sum(cluster == c) + 1)
        )


@pytest.mark.parametrize("block", [5, 1000])
def test_statistics_equal_brute_force(items, block):
    vectors, clusters = flooded(70, 10, True, 4)
    rows = table(items, vectors, clusters)
    u = vectors.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    extremes = {r.item_id: r for r in extreme_sims(rows, block=block).collect()}
    spread = {r.cluster_id: r for r in pairwise_std(rows, chunk=block).collect()}
    for c in set(clusters.tolist()):
        ids = np.where(clusters == c)[0]
        sims = u[ids] @ u[ids].T
        np.fill_diagonal(sims, 0.0)
        for p, i in enumerate(ids):
            assert extremes[i].max_sim == pytest.approx(sims[p].max(), abs=1e-9)
            assert extremes[i].min_sim == pytest.approx(sims[p].min(), abs=1e-9)
        assert spread[c].std_pair_sim == pytest.approx(sims.std(ddof=1), abs=1e-9)
        assert spread[c].cluster_size == len(ids)


@pytest.mark.parametrize("block", [5, 16])
@pytest.mark.parametrize("eps_list", [[0.01], [0.002, 0.1]])
def test_flags_with_block_pairs_left_out(items, block, eps_list):
    """Vectors at many angles to the pivot, in the order of that angle."""
    rng = np.random.default_rng(block)
    angle = np.sort(rng.uniform(0, np.pi, 160))[::-1]
    turn = rng.uniform(0, 0.6, 160)
    vectors = np.stack([np.cos(angle), np.sin(angle) * np.cos(turn), np.sin(angle) * np.sin(turn)], axis=1)
    vectors[7] = 0
    clusters = np.arange(160) % 2
    rows = table(items, vectors, clusters)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    dist = {i: float(1 - u[0]) for i, u in enumerate(unit)}
    spark = rows.sparkSession
    dists = spark.createDataFrame(list(dist.items()), "item_id long, dist double")
    expected = brute_force(vectors, clusters)
    pruned = prune_table(
        rows.join(dists, "item_id"), eps_list, block=block, carry=["dist"], pivot_dist="dist"
    ).collect()
    assert len(pruned) == 160
    for r in pruned:
        for eps in eps_list:
            assert r["eps_" + str(eps).replace(".", "_")] == (expected[r.item_id] > 1 - eps)
