"""Seeded samples, previews and splits; all depend on the seed and the ids only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecprune.functions.hashing import seeded_hash
from vecprune.operators.ordinal import ordinal
from vecprune.operators.sizes import cluster_sizes, one_cluster, top_clusters
from vecprune.staging import stage_table

# A preview sample up to this many rows is broadcast to the dataset scan.
PREVIEW_ROWS = 1_000_000


def sample_per_cluster(df: DataFrame, m: int, seed: int = 1234) -> DataFrame:
    """Up to ``m`` random rows of each cluster.

    Spark keeps only the first ``m`` of a cluster in every task before the shuffle, so a
    hot cluster does not travel.
    """
    order = Window.partitionBy("cluster_id").orderBy("_hash", "item_id")
    return (
        df.withColumn("_hash", seeded_hash(seed, "item_id"))
        .withColumn("_no", F.row_number().over(order))
        .where(F.col("_no") <= m)
        .drop("_hash", "_no")
    )


def preview_rows(
    sample: DataFrame, dataset: DataFrame, *, id_col: str = "item_id", max_rows: int | None = None
) -> DataFrame:
    """The sample with the payload of the dataset; ``is_placeholder`` where it has none.

    With ``max_rows`` (a bound on the sample) small enough, the big dataset is filtered in
    place by the broadcast sample ids instead of being shuffled.
    """
    payload = dataset
    if max_rows is not None and max_rows <= PREVIEW_ROWS:
        payload = dataset.join(F.broadcast(sample.select(id_col)), id_col, "left_semi")
    found = payload.withColumn("_found", F.lit(True))
    missing = F.col("_found").isNull()
    return sample.join(found, id_col, "left").withColumn("is_placeholder", missing).drop("_found")


def preview(
    df: DataFrame,
    dataset: DataFrame,
    *,
    n_clusters: int = 5,
    per_cluster: int = 9,
    cluster_id: int | None = None,
    seed: int = 1234,
) -> DataFrame:
    """Random members, with payload, of the largest clusters or of one chosen cluster:
    ``(item_id, cluster_id, cluster_size, dist, payload..., is_placeholder)``."""
    members = df.select("item_id", "cluster_id", "dist")
    if cluster_id is None:
        chosen = top_clusters(members, n_clusters)
    else:
        members = one_cluster(members, cluster_id)
        chosen = cluster_sizes(members)
        n_clusters = 1
    few = n_clusters <= PREVIEW_ROWS
    picked = members.join(F.broadcast(chosen) if few else chosen, "cluster_id")
    # A few rows per cluster, used twice: stored rather than drawn again.
    sample = stage_table(sample_per_cluster(picked, per_cluster, seed), "sample")
    return preview_rows(sample, dataset, max_rows=n_clusters * per_cluster)


def train_test_split(
    df: DataFrame,
    train_fraction: float = 0.8,
    seed: int = 1234,
    *,
    id_col: str = "item_id",
    exact: bool = False,
) -> DataFrame:
    """Add ``split``: ``train`` or ``test``.

    By default each row decides by its hash, without a shuffle, and the sizes are right on
    average.  ``exact`` takes the first ``floor(fraction * n)`` rows in hash order.
    """
    if not 0.0 <= train_fraction <= 1.0:
        raise ValueError("train_fraction must lie in [0, 1]")
    hashed = df.withColumn("_hash", seeded_hash(seed, id_col))
    if not exact:
        cut = int(train_fraction * 1_000_000)
        is_train = F.col("_hash") % 1_000_000 < cut
    else:
        n_train = int(train_fraction * df.count())
        hashed = ordinal(hashed, [F.col("_hash").asc(), F.col(id_col).asc()], name="_no")
        is_train = F.col("_no") <= n_train
    split = F.when(is_train, "train").otherwise("test")
    return hashed.withColumn("split", split).drop("_hash", "_no")
