"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose
the data and the cores.  Every query runs to the end into a sink that drops its rows.

Besides catalog queries there is the whole job taken apart, on the documents and on generated
vectors of the reference workload's shape (23,410 x 512, 599 clusters): encode, train, assign,
rank, prune; and the pruning of one hot cluster.  Stage tables are dropped after each job.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from vecprune.operators.assign import assign, dist_to_centroid
from vecprune.operators.encode import hash_encoder
from vecprune.operators.gather import keep_items
from vecprune.operators.kmeans import fit_kmeans, mean_centroids
from vecprune.operators.prune import prune_table, select_pruned
from vecprune.operators.rank import rank_within_cluster
from vecprune.plans.catalog import QUERIES
from vecprune.session import ship_package
from vecprune.sources.readers import spread_scan
from vecprune.staging import drop_stages, stage_table

HEADLINE = [
    "assign_cosine",
    "rank_hard",
    "max_earlier_sim",
    "max_earlier_sim_blocks",
    "flags_eps_list",
    "avg_sim_to_others",
    "extreme_sims",
    "pairwise_std",
    "duplicate_report",
    "cluster_sizes",
    "resolve_files",
    "hash_encode",
    "dedup_documents_by_lang",
]
DIM, CLUSTERS, ROUNDS, SEED, EPS = 512, 64, 10, 1234, 0.05
REFERENCE_ROWS, REFERENCE_CLUSTERS, REFERENCE_ROUNDS = 23_410, 599, 5
HOT_ROWS, HOT_DIM = 40_000, 64


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def clustered_vectors(spark, rows: int, dim: int, clusters: int, spread: float):
    """Vectors around random centers, every tenth nearly a copy of the one before; made in
    the tasks from the ids alone."""

    def make(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            matrix = np.empty((len(ids), dim), np.float32)
            for row, i in zip(matrix, ids.tolist()):
                source = i - 1 if i % 10 == 9 else i
                center = np.random.default_rng(source % clusters).standard_normal(dim)
                row[:] = center + spread * np.random.default_rng((7, source)).standard_normal(dim)
                if source != i:
                    row += 0.001 * np.random.default_rng((8, i)).standard_normal(dim)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), dim).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item_id", "embedding"])

    made = spark.range(rows).mapInArrow(make, "item_id long, embedding array<float>")
    return stage_table(made, "bench")


def vector_steps(name, vectors, k, rounds, timed):
    """Train, assign, rank and prune; returns the pruning table."""
    cents = timed(f"{name}_train", lambda: fit_kmeans(vectors, k, rounds, SEED))
    clustered = timed(
        f"{name}_assign",
        lambda: stage_table(dist_to_centroid(assign(vectors, cents, "cosine")), "bench"),
    )
    ranked = timed(
        f"{name}_rank",
        lambda: stage_table(
            rank_within_cluster(clustered).withColumn("order_pos", F.col("pos")), "bench"
        ),
    )
    return timed(f"{name}_prune", lambda: stage_table(prune_table(ranked, [EPS]), "bench"))


def job_steps(spark, sf_dir, timed) -> None:
    """The whole jobs, each step timed on the stored result of the step before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "item_id")
    texts = spread_scan(docs)
    vectors = timed(
        "job_encode",
        lambda: stage_table(
            hash_encoder(texts, "text", DIM, normalize=False).select("item_id", "embedding"), "bench"
        ),
    )
    pruned = vector_steps("job", vectors, CLUSTERS, ROUNDS, timed)
    timed("job_keep", lambda: run_all(keep_items(docs, select_pruned(pruned, EPS), path_col=None)))
    drop_stages(spark)

    vectors = clustered_vectors(spark, REFERENCE_ROWS, DIM, REFERENCE_CLUSTERS, 0.5)
    vector_steps("reference_shape", vectors, REFERENCE_CLUSTERS, REFERENCE_ROUNDS, timed)
    drop_stages(spark)

    hot = clustered_vectors(spark, HOT_ROWS, HOT_DIM, 1, 1.0).withColumn("cluster_id", F.lit(0))
    measured = dist_to_centroid(hot, mean_centroids(hot))
    ordered = stage_table(rank_within_cluster(measured).withColumn("order_pos", F.col("pos")), "bench")
    timed("hot_cluster_flags", lambda: run_all(prune_table(ordered, [EPS], carry=["dist"], pivot_dist="dist")))
    drop_stages(spark)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecprune-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    run_all(QUERIES["assign_cosine"](spark, sf_dir))  # starts the Python workers

    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    for name in HEADLINE:
        timed(name, lambda name=name: run_all(QUERIES[name](spark, sf_dir)))
    job_steps(spark, sf_dir, timed)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
