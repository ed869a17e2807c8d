"""Tiles of small blocks: how often a row is sent, and the same results for every tile size."""

import numpy as np
import pytest
from test_prune_properties import brute_force, flooded, table

from vecprune.operators import pairs, prune
from vecprune.operators.prune import max_earlier_sim, prune_table
from vecprune.operators.stats import extreme_sims


def _counted(spark, kernel_of):
    """A kernel that counts the rows it is given."""
    total = spark.sparkContext.accumulator(0)

    def counting(*args):
        kernel = kernel_of(*args)

        def run(batches):
            def each():
                for batch in batches:
                    total.add(batch.num_rows)
                    yield batch

            yield from kernel(each())

        return run

    return total, counting


def test_small_blocks_send_a_row_a_few_times(spark, items, monkeypatch):
    rng = np.random.default_rng(3)
    vectors, clusters = rng.normal(size=(1200, 6)), np.zeros(1200, int)
    rows = table(items, vectors, clusters)
    for module, name, run in (
        (pairs, "values_in_tiles", lambda: extreme_sims(rows, block=4)),
        (prune, "earlier_in_tiles", lambda: max_earlier_sim(rows, block=4)),
    ):
        total, counting = _counted(spark, getattr(module, name))
        monkeypatch.setattr(module, name, counting)
        assert run().count() == 1200
        # Held once and streamed once.
        assert 0 < total.value <= 2 * 1200, name


@pytest.mark.parametrize("held_rows", [1, 24, 1 << 14])
@pytest.mark.parametrize("share", [0.0, 0.5])
def test_tiles_of_every_size(items, monkeypatch, held_rows, share):
    monkeypatch.setattr(pairs, "HELD_ROWS", held_rows)
    monkeypatch.setattr(pairs, "STREAMED_ROWS", 8 * held_rows)
    vectors, clusters = flooded(400, max(1, int(400 * share)), False, 8)
    rows = table(items, vectors, clusters)
    expected = brute_force(vectors, clusters)
    got = {r.item_id: r.max_earlier_sim for r in max_earlier_sim(rows, block=3).collect()}
    assert got == pytest.approx(expected, abs=1e-9)
    flags = {r.item_id: r.eps_0_1 for r in prune_table(rows, [0.1], block=3).collect()}
    assert flags == {i: bool(v > 0.9) for i, v in expected.items()}
    u = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    sims = u @ u.T
    np.fill_diagonal(sims, 0.0)
    for r in extreme_sims(rows, block=3).collect():
        mine = np.where(clusters == clusters[r.item_id], sims[r.item_id], 0.0)
        assert r.max_sim == pytest.approx(max(mine.max(), 0.0), abs=1e-6)
        assert r.min_sim == pytest.approx(min(mine.min(), 0.0), abs=1e-6)
