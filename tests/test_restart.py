"""Saves that died, reports that go on, empty inputs, encoders kept by a worker."""

import collections
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecprune.operators.assign import assign, load_or_assign
from vecprune.operators.encode import embed
from vecprune.operators.kmeans import load_or_fit, mean_centroids
from vecprune.operators.select import eps_for_kept, order_statistic
from vecprune.options import DedupOptions
from vecprune.plans.dedup import dedup, dedup_given_clusters
from vecprune.plans.reports import prune_report, write_report
from vecprune.staging import save_table, table_exists


@pytest.fixture(scope="module")
def members(spark):
    rows = [(i, i % 4, [float(i % 7 + 1), 1.0, float(i % 3)]) for i in range(60)]
    return spark.createDataFrame(rows, "item_id long, cluster_id int, embedding array<float>")


def half_written(path: pathlib.Path) -> None:
    """What a run leaves that died while its tasks wrote: files without the marker."""
    path.mkdir(parents=True)
    (path / "part-00000.parquet").write_bytes(b"PAR1 cut off")
    (path / "_temporary").mkdir()


def test_died_saves_are_replaced(spark, members, tmp_path):
    half_written(tmp_path / "centroids")
    half_written(tmp_path / "assigned")
    side = tmp_path / "centroids.unfinished-0123"
    half_written(side)
    (tmp_path / "centroids-of-others").mkdir()
    cents = load_or_fit(str(tmp_path / "centroids"), members, mean_centroids)
    found = load_or_assign(str(tmp_path / "assigned"), members, cents)
    assert cents.count() == 4 and found.count() == 60
    assert sorted(p.name for p in tmp_path.iterdir()) == ["assigned", "centroids", "centroids-of-others"]

    def never(_):
        raise AssertionError("there is a saved table")

    assert load_or_fit(str(tmp_path / "centroids"), members, never).count() == 4


def test_a_failing_save_leaves_no_table(spark, members, tmp_path):
    path = str(tmp_path / "t")
    bad = members.withColumn("x", F.raise_error(F.lit("died")).cast("int"))
    with pytest.raises(Exception, match="died"):
        save_table(bad, path)
    assert not table_exists(spark, path) and not (tmp_path / "t").exists()
    save_table(members, path)
    save_table(members.limit(1), path)  # another run was faster: its table stays
    assert spark.read.parquet(path).count() == 60


def ordered_members(members):
    return members.withColumns(
        {"dist": F.lit(0.25), "order_pos": F.expr("cast((item_id - cluster_id) div 4 + 1 as bigint)")}
    )


def by_item(df):
    return {
        (r.cluster_id, r.item_id): (
            r.eps_0_01, r.eps_0_3, round(r.avg_sim_to_others, 9), round(r.max_sim, 9), round(r.min_sim, 9),
            round(r.max_earlier_sim, 9),
        )
        for r in df.collect()
    }


def test_stopped_report_goes_on(spark, members, tmp_path, monkeypatch):
    from vecprune.plans import reports

    ordered, path, eps = ordered_members(members), str(tmp_path / "r"), [0.01, 0.3]
    whole = prune_report(ordered, eps)
    seen = []
    stats = reports._all_items

    def dies_on_the_third(rows, *rest):
        clusters = sorted({r.cluster_id for r in rows.select("cluster_id").collect()})
        seen.append(clusters)
        if len(seen) == 3:
            raise RuntimeError("lost")
        return stats(rows, *rest)

    monkeypatch.setattr(reports, "_all_items", dies_on_the_third)
    with pytest.raises(RuntimeError, match="lost"):
        write_report(ordered, path, eps, ranges=4)
    report = write_report(ordered, path, eps, ranges=4)
    # The first two clusters were not looked at again.
    assert seen[:3] == [[0], [1], [2]] and sorted(sum(seen[3:], [])) == [2, 3]
    assert by_item(report["items"]) == by_item(whole["items"])
    for name in ("clusters", "eps_report", "sweep"):
        got, want = (sorted(map(tuple, t[name].select(whole[name].columns).collect())) for t in (report, whole))
        assert np.array_equal(np.round(np.array(got, float), 9), np.round(np.array(want, float), 9))


@pytest.mark.parametrize("block", [1, 4, 8192])
def test_report_equals_brute_force(spark, members, block):
    """Exact copies, a zero vector, an item alone and an id in two clusters."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, rng.standard_normal(3).tolist()) for i in range(70)]
    rows += [(100 + i, 0, [1.0, 2.0, 3.0]) for i in range(9)] + [(200, 1, [0.0] * 3), (201, 1, [0.0] * 3)]
    rows += [(300, 5, [1.0, 0.0, 0.0]), (7, 6, [0.0, 1.0, 0.0]), (8, 6, [0.0, 1.0, 1.0]), (7, 7, [1.0] * 3)]
    place = collections.Counter()
    full = []
    for i, c, v in rows:
        place[c] += 1
        full.append((i, c, v, 0.25, place[c]))
    df = spark.createDataFrame(full, "item_id long, cluster_id int, embedding array<double>, dist double, order_pos long")
    got = {(r.cluster_id, r.item_id): r for r in prune_report(df, [0.3], block=block)["items"].collect()}
    assert len(got) == len(full)
    for i, c, v, _, pos in full:
        def unit(x):
            n = np.linalg.norm(x)
            return np.array(x) / n if n else np.array(x)
        others = [(p, float(unit(v) @ unit(w))) for _, k, w, _, p in full if k == c and p != pos]
        r = got[c, i]
        earlier = max([s for p, s in others if p < pos] + [0.0])
        assert r.max_earlier_sim == pytest.approx(earlier, abs=1e-9)
        if not others:
            assert r.max_sim is None and r.min_sim is None
        else:
            assert r.max_sim == pytest.approx(max(0.0, *[s for _, s in others]), abs=1e-9)
            assert r.min_sim == pytest.approx(min(0.0, *[s for _, s in others]), abs=1e-9)


def test_empty_inputs_have_empty_results(spark):
    options = DedupOptions(k=3, niter=2, eps_list=(0.1,))
    docs = spark.createDataFrame([], "item_id long, text string")
    kept, rejects = dedup(docs, options)
    assert kept.columns == ["item_id", "text"] and kept.count() == 0 and rejects.count() == 0
    given = spark.createDataFrame([], "item_id long, cluster_id string, embedding array<float>")
    rows, rejects = dedup_given_clusters(given, options)
    assert rows.count() == 0 and rejects.count() == 0
    ordered = spark.createDataFrame([], "item_id long, cluster_id int, embedding array<float>, dist double, order_pos long")
    report = prune_report(ordered, [0.1])
    assert all(report[name].count() == 0 for name in ("items", "clusters", "eps_report", "rejects"))
    cents = spark.createDataFrame([], "cluster_id int, centroid array<double>")
    items = given.drop("cluster_id")
    assert assign(items, cents).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "item_id long, embedding array<float>")
    with pytest.raises(Exception, match="centroid table is empty"):
        assign(one, cents).collect()


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_numbered_clusters_keep_their_keys(spark, kind):
    keys = ["b", "a", None] if kind == "string" else [2**40, 5, None]
    rows = [(i, keys[i % 3], [1.0, float(i)]) for i in range(9)]
    # Also where the key has the name of the number.
    for name in ("k", "cluster_id"):
        df = spark.createDataFrame(rows, f"item_id long, {name} {kind}, embedding array<float>")
        out = dedup_given_clusters(df, DedupOptions(eps_list=(0.01,)), cluster_col=name).rows
        got = {r.item_id: (r.cluster_id, r.cluster_key) for r in out.collect()}
        assert got == {i: (1 - i % 3, keys[i % 3]) for i in range(9) if i % 3 < 2}


def test_encoder_is_made_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory(mark):
        def make_encoder():
            import os
            import uuid

            open(f"{folder}/{mark}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
            return lambda texts: np.array([[len(t), 1.0, os.getpid()] for t in texts])

        return make_encoder

    docs = spark.range(400).select("id", F.concat(F.lit("t"), F.col("id")).alias("text")).repartition(40)
    for _ in range(2):
        assert embed(docs, "id", "text", factory("a")).count() == 400
    made = [p.name.split("-")[1] for p in tmp_path.iterdir()]
    assert made and max(collections.Counter(made).values()) == 1
    # Another encoder is another one.
    embed(docs, "id", "text", factory("b")).count()
    assert {p.name[0] for p in tmp_path.iterdir()} == {"a", "b"}


def test_encoder_calls_are_bounded_in_bytes(spark):
    def make_encoder():
        return lambda texts: np.array([[sum(map(len, texts)), len(texts)] for _ in texts])

    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([10, 10, 10, 500, 10, 10])], "id long, text string")
    got = {r.id: r.embedding for r in embed(docs.coalesce(1), "id", "text", make_encoder, call_bytes=25).collect()}
    shapes = {i: round(v[0] / v[1]) for i, v in got.items()}
    assert shapes == {0: 10, 1: 10, 2: 10, 3: 500, 4: 10, 5: 10}


@pytest.mark.parametrize("bins", [2, 4096])
def test_order_statistics(spark, bins):
    rng = np.random.default_rng(4)
    values = [0.5] * 40 + rng.random(50).tolist() + [1.0] * 7 + [0.5 + 1e-16, 1e-300, 0.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    df = df.repartition(3).persist()
    for rank in (1, 2, 30, 60, len(values)):
        assert order_statistic(df, "v", rank, bins) == sorted(values)[rank - 1]
    assert order_statistic(df, "v", 0) is None and order_statistic(df, "v", len(values) + 1) is None


def test_eps_for_kept(spark):
    sims = [0.0, 0.25, 0.5, 0.5, 0.75, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(s,) for s in sims], "max_earlier_sim double")
    got = {r.fraction: r.eps for r in eps_for_kept(df, [0.0, 0.125, 0.25, 0.3, 0.5, 0.6, 0.7, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.125: 1.0, 0.25: 0.75, 0.3: 0.5, 0.5: 0.5, 0.6: 0.25, 0.7: None, 1.0: None}
    for fraction, eps in got.items():
        if eps is not None:
            assert sum(s <= 1 - eps for s in sims) >= fraction * len(sims)
