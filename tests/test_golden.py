"""Cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from vecprune.functions.vectors import cosine_sim, l2_normalize
from vecprune.operators.assign import assign, dist_to_centroid
from vecprune.operators.prune import flag_duplicates, max_earlier_sim, prune_table, select_pruned
from vecprune.operators.rank import order_policy, rank_within_cluster, split_clusters
from vecprune.operators.sizes import cluster_sizes, size_histogram, size_summary
from vecprune.operators.stats import (
    avg_sim_to_others,
    centroid_cohesion,
    duplicate_report,
    extreme_sims,
    pairwise_std,
)
from vecprune.operators.validate import assert_unique, split_valid
from vecprune.options import DedupOptions
from vecprune.plans.dedup import dedup_given_clusters


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.fixture(scope="module")
def chain(items):
    return items([(0, 0, at(0)), (1, 0, at(10)), (2, 0, at(20))], kind="double")


def by_id(df, column):
    return {r["item_id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize(
    "which, removed, sims",
    [
        ("hard", {1}, {0: 0.0, 2: 0.939693, 1: 0.984808}),
        ("easy", {0, 2}, {1: 0.0, 2: 0.984808, 0: 0.984808}),
    ],
)
def test_chain_in_distance_order(chain, which, removed, sims):
    pruned = dedup_given_clusters(chain, DedupOptions(eps_list=(0.03,), which=which)).rows.cache()
    ordered = chain.join(pruned.select("item_id", "order_pos"), "item_id")
    assert by_id(max_earlier_sim(ordered), "max_earlier_sim") == pytest.approx(sims, abs=1e-6)
    assert {r.item_id for r in select_pruned(pruned, 0.03, kept=False).collect()} == removed
    assert {r.item_id for r in select_pruned(pruned, 0.03).collect()} == {0, 1, 2} - removed


@pytest.mark.parametrize("block", [1, 2, 100])
def test_chain_is_not_pruned_greedily(chain, block):
    given = chain.withColumn("order_pos", F.col("item_id") + 1)
    pruned = prune_table(given, [0.03], block=block)
    assert by_id(pruned, "eps_0_03") == {0: False, 1: True, 2: True}


def test_chain_statistics(chain):
    members = dist_to_centroid(
        chain, chain.sparkSession.createDataFrame([(0, at(10))], "cluster_id int, centroid array<double>")
    )
    assert by_id(avg_sim_to_others(chain), "avg_sim_to_others") == pytest.approx(
        {0: 0.962250, 1: 0.984808, 2: 0.962250}, abs=1e-6
    )
    extremes = extreme_sims(chain)
    assert by_id(extremes, "max_sim") == pytest.approx({i: 0.984808 for i in range(3)}, abs=1e-6)
    assert by_id(extremes, "min_sim") == {0: 0.0, 1: 0.0, 2: 0.0}
    assert pairwise_std(chain).first().std_pair_sim == pytest.approx(0.485234, abs=1e-6)
    cohesion = centroid_cohesion(members).first()
    assert cohesion.avg_sim_to_cent == pytest.approx(0.989872, abs=1e-6)
    assert cohesion.std_sim_to_cent == pytest.approx(0.007162, abs=1e-6)


def test_alone_in_its_cluster(items):
    one = items([(7, 3, [0.6, 0.8])])
    pruned = dedup_given_clusters(one, DedupOptions(eps_list=(1e-6, 0.5, 1.0))).rows
    row = pruned.first()
    assert max_earlier_sim(one.withColumn("order_pos", F.lit(1))).first().max_earlier_sim == 0.0
    assert not (row["eps_1e_06"] if "eps_1e_06" in pruned.columns else row["eps_1em06"])
    assert not row["eps_0_5"] and not row["eps_1_0"]
    assert avg_sim_to_others(one).first().avg_sim_to_others is None
    assert extreme_sims(one).first().max_sim is None
    assert pairwise_std(one).first().std_pair_sim is None
    report = duplicate_report(pruned, [0.5]).first()
    assert (report.cluster_size, report.num_duplicates, report.duplicates_ratio) == (1, 0, 0.0)


def test_copies_opposites_and_zero(items):
    rows = items(
        [
            (0, 0, [1.0, 2.0]), (1, 0, [1.0, 2.0]),
            (2, 1, [1.0, 0.0]), (3, 1, [-1.0, 0.0]),
            (4, 2, [0.0, 0.0]), (5, 2, [3.0, 4.0]),
        ]
    ).withColumn("order_pos", F.col("item_id") % 2 + 1)
    pruned = prune_table(rows, [1e-6, 1.0])
    assert by_id(max_earlier_sim(rows), "max_earlier_sim") == pytest.approx(
        {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}, abs=1e-9
    )
    assert by_id(pruned, "eps_1_0") == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False}
    extremes = {r.item_id: (r.max_sim, r.min_sim) for r in extreme_sims(rows).collect()}
    assert extremes[2] == extremes[3] == (0.0, -1.0)
    assert extremes[4] == extremes[5] == (0.0, 0.0)
    unit = by_id(rows.select("item_id", l2_normalize("embedding").alias("u")), "u")
    assert unit[4] == [0.0, 0.0] and unit[5] == pytest.approx([0.6, 0.8])
    sims = by_id(rows.select("item_id", cosine_sim("embedding", "embedding").alias("s")), "s")
    assert sims[4] == 0.0 and sims[5] == pytest.approx(1.0)


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.5000001)], "item_id long, max_earlier_sim double")
    assert by_id(flag_duplicates(rows, [0.5]), "eps_0_5") == {0: False, 1: True}


def test_easy_reverses_ties_too(items):
    rows = items([(i, 0, [1.0, 0.0], 0.5) for i in range(5)])
    hard = order_policy(rank_within_cluster(rows), "hard")
    easy = order_policy(rank_within_cluster(rows), "easy")
    assert by_id(hard, "order_pos") == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5}
    assert by_id(easy, "order_pos") == {0: 5, 1: 4, 2: 3, 3: 2, 4: 1}
    nearest = rank_within_cluster(rows, keep_hard=False)
    assert by_id(nearest, "pos") == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5}


@pytest.mark.parametrize("eps", [0, -0.1, 1.5, float("nan")])
def test_eps_bounds(eps):
    with pytest.raises(ValueError):
        DedupOptions(eps_list=(eps,))


def test_options_are_checked():
    with pytest.raises(ValueError, match="spherical"):
        DedupOptions(metric="l2", spherical=True)
    with pytest.raises(ValueError, match="unknown options: ncentroid"):
        DedupOptions.from_mapping({"ncentroid": 3})
    assert DedupOptions.from_mapping({"k": 5, "which": "easy"}).k == 5


def test_l2_with_spherical_is_refused(items):
    with pytest.raises(ValueError):
        dist_to_centroid(items([(0, 0, [1.0])]), None, "l2", spherical=True)


def test_bad_vectors_are_set_aside(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0])],
        "item_id long, embedding array<float>",
    )
    usable, rejects = split_valid(rows, dim=2)
    assert [r.item_id for r in usable.collect()] == [0]
    assert by_id(rejects, "reason") == {
        1: "null", 2: "dimension", 3: "not finite", 4: "not finite", 5: "not finite"
    }


@pytest.mark.parametrize("n, size, bounds", [(10, 4, [0, 3, 6, 10]), (7, 4, [0, 3, 7]), (4, 4, [0, 4])])
def test_part_bounds(spark, n, size, bounds):
    rows = spark.range(1, n + 1).select(F.lit(0).alias("cluster_id"), F.col("id").alias("order_pos"))
    parts = {r.order_pos - 1: r.part for r in split_clusters(rows, size).collect()}
    expected = [p for p in range(len(bounds) - 1) for _ in range(bounds[p], bounds[p + 1])]
    assert [parts[i] for i in range(n)] == expected


def test_sizes_with_and_without_empty_clusters(spark):
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 2)], "item_id long, cluster_id int")
    sizes = cluster_sizes(members)
    assert tuple(size_summary(sizes).first()) == (2, 3, 1, 2.0, 1)
    assert tuple(size_summary(sizes, include_empty=True).first()) == (3, 3, 0, 4 / 3, 1)


def test_histogram(spark):
    sizes = spark.createDataFrame(list(enumerate([1, 1, 10, 11, 40])), "cluster_id int, cluster_size long")
    bins = {r.size_bin: r.n_clusters for r in size_histogram(sizes).collect()}
    assert bins == {**{b: 0 for b in range(1, 12)}, 1: 2, 10: 1, 11: 2}


def test_repeated_keys_are_reported(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (1, "a")], "cluster_id int, path string")
    with pytest.raises(ValueError, match="'a' is stored 2 times"):
        assert_unique(rows)
    assert assert_unique(rows.distinct()).count() == 2


def test_equal_centroids_tie_to_the_lowest_id(items, spark):
    rows = items([(i, 0, [float(i % 3 + 1), 1.0, 0.0]) for i in range(9)]).drop("cluster_id")
    cents = spark.createDataFrame(
        [(c, [1.0, 1.0, 0.0]) for c in range(5)], "cluster_id int, centroid array<double>"
    )
    for metric in ("cosine", "ip", "l2"):
        for limit in (1 << 20, 48):
            found = assign(rows, cents, metric, limit_bytes=limit)
            assert {r.cluster_id for r in found.collect()} == {0}
