"""Flags of groups of several tiles: how often a row is sent, and the products that are made."""

import numpy as np
import pyarrow as pa
import pytest
from test_prune_properties import brute_force, table
from test_tiles import _counted

from vecprune.operators import pairs, prune
from vecprune.operators.prune import prune_table


def _mixed(n, seed, dim=40):
    """Rows around a common direction at all angles, near copies, opposite ones and zero vectors."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=dim)
    x = middle + rng.normal(size=(n, dim)) * rng.uniform(0.05, 4.0, size=(n, 1))
    near = rng.choice(n, n // 4, replace=False)
    x[near] = x[rng.permutation(near)] + rng.normal(size=(len(near), dim)) * rng.uniform(0.0, 0.5, size=(len(near), 1))
    x[:: n // 7] = 0.0
    x[1 :: n // 5] *= -1.0
    return x


def test_copies_of_a_row_do_not_grow_with_the_group(spark, items, monkeypatch):
    monkeypatch.setattr(pairs, "HELD_ROWS", 16)
    monkeypatch.setattr(pairs, "STREAMED_ROWS", 1 << 17)
    rng = np.random.default_rng(5)
    sent = []
    for n in (1000, 4000):
        rows = table(items, rng.normal(size=(n, 12)), np.zeros(n, int))
        total, counting = _counted(spark, pairs.flags_in_tiles if hasattr(pairs, "flags_in_tiles") else pairs.earlier_in_tiles)
        monkeypatch.setattr(prune, "flags_in_tiles", counting, raising=False)
        assert prune_table(rows, [0.05], block=8).count() == n
        sent.append(total.value / n)
    # Once held, and streamed to half of the 16 parts.
    assert 0 < sent[1] <= 1 + 10
    assert sent[1] < 1.2 * sent[0]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("axes", [(96, 256), (4, 9), (4, 256)])
def test_flags_of_tiles(items, monkeypatch, seed, axes):
    for name, value in (("HELD_ROWS", 24), ("STREAMED_ROWS", 200), ("LEADING", axes[0]), ("MORE", axes[1]), ("COLUMNS", 32)):
        monkeypatch.setattr(pairs, name, value)
    vectors, clusters = _mixed(700, seed), np.zeros(700, int)
    expected = brute_force(vectors, clusters)
    flags = {r.item_id: (r.eps_0_03, r.eps_0_3) for r in prune_table(table(items, vectors, clusters), [0.03, 0.3], block=8).collect()}
    assert flags == {i: (bool(v > 0.97), bool(v > 0.7)) for i, v in expected.items()}
    assert 20 < sum(a for a, _ in flags.values()) < 680


def test_few_products_are_made_of_unlike_rows(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 128)) * np.arange(128, 0, -1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5999] = x[17]
    made = []
    compare = pairs.Flagged.compare
    monkeypatch.setattr(pairs.Flagged, "compare", lambda self, at, possible, *a: (made.append(np.count_nonzero(possible)), compare(self, at, possible, *a)))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 128).cast(pa.list_(pa.float64()))
    rows = pa.table({"_vec": lists, "_pos": np.arange(6000), "_best": np.zeros(6000), "_held": np.arange(6000) >= 3000})
    rows = rows.append_column("_tile", pa.array(["t"] * 6000)).sort_by([("_held", "descending")])
    (found,) = pairs.flags_in_tiles(["_pos"], [0.95])(iter(rows.to_batches()))
    best = dict(zip(found["_pos"].to_pylist(), found["_best"].to_pylist()))
    assert best[5999] == pytest.approx(1.0) and max(v for k, v in best.items() if k != 5999) <= 0.95
    assert sum(made) < 3000 * 3000 / 100
