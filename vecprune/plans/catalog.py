"""One query per operator over the shared tables; ``oracle`` holds the same in SQL.

``embeddings`` serves with its label as a ready cluster, ``documents`` with its language or
its length class; every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecprune.functions import names, vectors
from vecprune.operators import encode, evaluate, gather, manifest, prune, rank, sampling, sizes, stats
from vecprune.operators.assign import assign, dist_to_centroid, join_centroids, load_or_assign
from vecprune.operators.kmeans import fit_kmeans, lloyd, load_or_fit, mean_centroids
from vecprune.operators.ordinal import largest_group
from vecprune.operators.select import eps_for_kept as eps_of_fractions
from vecprune.operators.validate import repeated_keys, split_valid
from vecprune.options import DedupOptions
from vecprune.plans.dedup import (
    cluster_items,
    dedup,
    dedup_given_clusters,
    ordered_clusters,
    prune_clusters,
)
from vecprune.plans.reports import cluster_report, prune_report, write_report
from vecprune.session import ship_package
from vecprune.sources import raw, readers, writers
from vecprune.staging import stage_path, stage_table

EPS = (0.5, 0.6, 0.7)
DOC_EPS = (0.03, 0.05)
KEPT_FRACTIONS = (0.0, 0.1, 0.5, 0.9, 0.999)
SEED = 1234

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _r(col, digits: int = 6):
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("label").cast("int").alias("cluster_id"),
        "embedding",
    )


def _centroids(spark: SparkSession, sf_dir: str, spherical: bool = True) -> DataFrame:
    return stage_table(mean_centroids(_members(spark, sf_dir), spherical), "centroids")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist_to_centroid(_members(spark, sf_dir), _centroids(spark, sf_dir))


def _largest(spark: SparkSession, sf_dir: str) -> int:
    """Counted on the bare members, once for the ranking and the pruning."""
    return largest_group(_members(spark, sf_dir), ["cluster_id"])


def _ranked(spark: SparkSession, sf_dir: str, keep_hard: bool = True) -> DataFrame:
    largest = _largest(spark, sf_dir)
    return rank.rank_within_cluster(_measured(spark, sf_dir), keep_hard, largest=largest)


def _ordered(spark: SparkSession, sf_dir: str, which: str = "hard") -> DataFrame:
    options = DedupOptions(which=which, seed=SEED)
    return ordered_clusters(_measured(spark, sf_dir), options, largest=_largest(spark, sf_dir))


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = DedupOptions(eps_list=EPS)
    return prune_clusters(_measured(spark, sf_dir), options, largest=_largest(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread_scan(_table(spark, sf_dir, "documents"))


def _length_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.expr("cast(n_chars div 100 as int)").alias("cluster_id")
    )


def _elements(df: DataFrame, key: str, array_col: str) -> DataFrame:
    return df.select(key, F.posexplode(array_col).alias("i", "value")).select(
        key, F.col("i").cast("bigint").alias("i"), _r(F.col("value").cast("double")).alias("value")
    )


# -- vectors ------------------------------------------------------------------------------


@query
def l2_normalize(spark, sf_dir):
    unit = _members(spark, sf_dir).withColumn("u", vectors.l2_normalize("embedding"))
    return _elements(unit, "item_id", "u")


@query
def pair_dot(spark, sf_dir):
    rows = join_centroids(_members(spark, sf_dir), _centroids(spark, sf_dir, spherical=False))
    return rows.select("item_id", _r(vectors.dot("embedding", "centroid")).alias("dot"))


@query
def cosine_to_centroid(spark, sf_dir):
    rows = join_centroids(_members(spark, sf_dir), _centroids(spark, sf_dir, spherical=False))
    sim = vectors.cosine_sim("embedding", "centroid")
    dist = vectors.cosine_dist("embedding", "centroid")
    return rows.select("item_id", _r(sim).alias("sim"), _r(dist).alias("dist"))


@query
def l2_to_centroid(spark, sf_dir):
    rows = dist_to_centroid(
        _members(spark, sf_dir), _centroids(spark, sf_dir, spherical=False), "l2", spherical=False
    )
    return rows.select("item_id", _r("dist").alias("dist"))


@query
def l2_to_centroid_joined(spark, sf_dir):
    """Centroids too large for a broadcast (here: by a limit of 0 bytes) are joined."""
    rows = dist_to_centroid(
        _members(spark, sf_dir),
        _centroids(spark, sf_dir, spherical=False),
        "l2",
        spherical=False,
        limit_bytes=0,
    )
    return rows.select("item_id", _r("dist").alias("dist"))


@query
def valid_vectors(spark, sf_dir):
    usable, rejects = split_valid(_members(spark, sf_dir))
    counts = usable.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("usable"))
    return counts.unionByName(
        rejects.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("rejected"))
    )


# -- clustering ---------------------------------------------------------------------------


def _assigned(spark, sf_dir, metric):
    centroids = _centroids(spark, sf_dir, spherical=False)
    found = assign(_members(spark, sf_dir), centroids, metric)
    return found.select("item_id", "cluster_id", _r("score").alias("score"))


@query
def assign_cosine(spark, sf_dir):
    return _assigned(spark, sf_dir, "cosine")


@query
def assign_ip(spark, sf_dir):
    return _assigned(spark, sf_dir, "ip")


@query
def assign_l2(spark, sf_dir):
    return _assigned(spark, sf_dir, "l2")


@query
def assign_in_blocks(spark, sf_dir):
    """Centroids too large for one broadcast (here: by a limit of 2 KB) go block by block."""
    centroids = _centroids(spark, sf_dir, spherical=False)
    found = assign(_members(spark, sf_dir), centroids, "cosine", limit_bytes=2048)
    return found.select("item_id", "cluster_id", _r("score").alias("score"))


@query
def dist_from_score(spark, sf_dir):
    found = assign(_members(spark, sf_dir), _centroids(spark, sf_dir), "cosine")
    return dist_to_centroid(found).select("item_id", "cluster_id", _r("dist").alias("dist"))


@query
def lloyd_2_rounds(spark, sf_dir):
    moved = lloyd(_members(spark, sf_dir), _centroids(spark, sf_dir), 2)
    return _elements(moved, "cluster_id", "centroid")


@query
def lloyd_l2_1_round(spark, sf_dir):
    moved = lloyd(_members(spark, sf_dir), _centroids(spark, sf_dir, False), 1, spherical=False)
    return _elements(moved, "cluster_id", "centroid")


@query
def kmeans_cosine(spark, sf_dir):
    items = _members(spark, sf_dir).drop("cluster_id")
    options = DedupOptions(k=16, niter=3, seed=SEED)
    return cluster_items(items, options).select("item_id", "cluster_id", _r("dist").alias("dist"))


@query
def kmeans_l2(spark, sf_dir):
    items = _members(spark, sf_dir).drop("cluster_id")
    centroids = fit_kmeans(items, 16, 3, SEED, spherical=False)
    return assign(items, centroids, "l2").select("item_id", "cluster_id", _r("score").alias("score"))


def _plain_clusters(spark, sf_dir):
    """Clusters of plain k-means (here: its assignment to given centroids), cosine distances."""
    items = _members(spark, sf_dir).drop("cluster_id")
    options = DedupOptions(spherical=False, metric="cosine", seed=SEED)
    return cluster_items(items, options, _centroids(spark, sf_dir, spherical=False))


@query
def dist_cosine_plain_kmeans(spark, sf_dir):
    return _plain_clusters(spark, sf_dir).select("item_id", "cluster_id", _r("dist").alias("dist"))


@query
def rank_cosine_plain_kmeans(spark, sf_dir):
    ranked = rank.rank_within_cluster(_plain_clusters(spark, sf_dir))
    return ranked.select("item_id", "cluster_id", "pos")


# -- order --------------------------------------------------------------------------------


@query
def rank_hard(spark, sf_dir):
    return _ranked(spark, sf_dir).select("item_id", "cluster_id", "pos")


@query
def rank_nearest(spark, sf_dir):
    return _ranked(spark, sf_dir, keep_hard=False).select("item_id", "cluster_id", "pos")


@query
def rank_hot_cluster(spark, sf_dir):
    """The order taken from a range sort, as for clusters too large for one task."""
    ranked = rank.rank_within_cluster(_measured(spark, sf_dir), hot_rows=1)
    return ranked.select("item_id", "cluster_id", "pos")


def _some_without_cluster(spark, sf_dir):
    """Every seventh item is in no cluster; the distances are made up."""
    cluster = F.when(F.col("item_id") % 7 != 0, F.col("cluster_id"))
    dist = (F.col("item_id") * 37 % 101) * F.lit(1e-13)
    return _members(spark, sf_dir).withColumns({"cluster_id": cluster, "dist": dist})


@query
def rank_hot_null_clusters(spark, sf_dir):
    ranked = rank.rank_within_cluster(_some_without_cluster(spark, sf_dir), hot_rows=1)
    return rank.split_clusters(rank.order_policy(ranked, "easy"), 20).select(
        "item_id", "cluster_id", "pos", "order_pos", "part"
    )


@query
def order_easy(spark, sf_dir):
    return _ordered(spark, sf_dir, "easy").select("item_id", "cluster_id", "pos", "order_pos")


@query
def order_random(spark, sf_dir):
    return _ordered(spark, sf_dir, "random").select("item_id", "cluster_id", "pos", "order_pos")


@query
def split_clusters(spark, sf_dir):
    parts = rank.split_clusters(_ordered(spark, sf_dir), 20)
    return parts.select("item_id", "cluster_id", "order_pos", "part")


# -- pruning ------------------------------------------------------------------------------


def _sims(df):
    return df.select(
        "item_id", "cluster_id", "order_pos", _r("max_earlier_sim").alias("max_earlier_sim")
    )


@query
def max_earlier_sim(spark, sf_dir):
    return _sims(prune.max_earlier_sim(_ordered(spark, sf_dir)))


@query
def max_earlier_sim_blocks(spark, sf_dir):
    """Blocks of 16 rows, as for clusters larger than a block."""
    return _sims(prune.max_earlier_sim(_ordered(spark, sf_dir), block=16))


@query
def max_earlier_product(spark, sf_dir):
    """Raw inner products instead of cosines."""
    return _sims(prune.max_earlier_sim(_ordered(spark, sf_dir), normalize=False))


@query
def max_earlier_sim_in_parts(spark, sf_dir):
    parts = rank.split_clusters(_ordered(spark, sf_dir), 20)
    return _sims(prune.max_earlier_sim(parts, keys=["cluster_id", "part"]))


@query
def max_earlier_sim_null_clusters(spark, sf_dir):
    ranked = rank.rank_within_cluster(_some_without_cluster(spark, sf_dir))
    return _sims(prune.max_earlier_sim(ranked.withColumn("order_pos", F.col("pos")), block=16))


@query
def flags_in_blocks(spark, sf_dir):
    """The flags are the same for every block size."""
    flagged = prune.prune_table(_ordered(spark, sf_dir), EPS, block=16)
    return flagged.select("item_id", "cluster_id", *[names.eps_column(e) for e in EPS])


@query
def flags_eps_list(spark, sf_dir):
    flags = [names.eps_column(e) for e in EPS]
    return _pruned(spark, sf_dir).select("item_id", "cluster_id", *flags)


@query
def kept_items(spark, sf_dir):
    return prune.select_pruned(_pruned(spark, sf_dir), 0.7).select("item_id", "cluster_id")


@query
def removed_items(spark, sf_dir):
    return prune.select_pruned(_pruned(spark, sf_dir), 0.7, kept=False).select("item_id", "cluster_id")


@query
def dedup_given_clusters_easy(spark, sf_dir):
    options = DedupOptions(eps_list=EPS, which="easy")
    pruned = dedup_given_clusters(_members(spark, sf_dir), options).rows
    return prune.select_pruned(pruned, 0.6).select("item_id", "cluster_id", "pos", "order_pos")


@query
def rejects_given_clusters(spark, sf_dir):
    """Vectors that are NULL, too short or not finite, and items without a cluster."""
    case = F.col("item_id") % 50
    bad = (
        F.when(case == 0, F.lit(None).cast("array<float>"))
        .when(case == 1, F.slice("embedding", 1, 10))
        .when(case == 2, F.array_repeat(F.lit(float("nan")).cast("float"), 64))
        .otherwise(F.col("embedding"))
    )
    items = _members(spark, sf_dir).withColumns(
        {"embedding": bad, "cluster_id": F.when(case != 3, F.col("cluster_id"))}
    )
    rows, rejects = dedup_given_clusters(items, DedupOptions(eps_list=EPS, seed=SEED))
    kept = prune.select_pruned(rows, 0.6).select("item_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(rejects.select("item_id", F.col("reason").alias("outcome")))


@query
def resume_skip(spark, sf_dir):
    """Half of the clusters in a first run, the rest in a second one that skips them."""
    path = stage_path(spark, "pruning")
    ordered = _ordered(spark, sf_dir)

    def run(rows):
        return prune.prune_table(rows, EPS)

    writers.write_pruning(sizes.cluster_range(ordered, 0, 5), path, run)
    writers.write_pruning(ordered, path, run, ranges=2)
    rows = writers.read_pruning(spark, path)
    return rows.select("item_id", "cluster_id", "order_pos", names.eps_column(0.7))


# -- sizes --------------------------------------------------------------------------------


@query
def cluster_sizes(spark, sf_dir):
    return sizes.cluster_sizes(_length_classes(spark, sf_dir))


@query
def size_summary(spark, sf_dir):
    summary = sizes.size_summary(sizes.cluster_sizes(_length_classes(spark, sf_dir)))
    return summary.withColumn("mean_size", _r("mean_size"))


@query
def size_summary_with_empty(spark, sf_dir):
    counted = sizes.cluster_sizes(_length_classes(spark, sf_dir))
    return sizes.size_summary(counted, include_empty=True).withColumn("mean_size", _r("mean_size"))


@query
def size_histogram(spark, sf_dir):
    return sizes.size_histogram(sizes.cluster_sizes(_length_classes(spark, sf_dir)))


@query
def rank_clusters(spark, sf_dir):
    return sizes.rank_clusters(_length_classes(spark, sf_dir))


@query
def cluster_report_clusters(spark, sf_dir):
    return cluster_report(_length_classes(spark, sf_dir))["clusters"]


@query
def ranked_members(spark, sf_dir):
    return sizes.ranked_members(_length_classes(spark, sf_dir))


@query
def cluster_members(spark, sf_dir):
    return sizes.cluster_members(_length_classes(spark, sf_dir))


@query
def top_clusters(spark, sf_dir):
    return sizes.top_clusters(_length_classes(spark, sf_dir), 5)


@query
def one_cluster(spark, sf_dir):
    return sizes.one_cluster(_length_classes(spark, sf_dir), 3)


@query
def cluster_range(spark, sf_dir):
    return sizes.cluster_range(_length_classes(spark, sf_dir), 2, 10)


@query
def unique_keys(spark, sf_dir):
    keyed = _table(spark, sf_dir, "documents").select("lang", F.md5("text").alias("key"))
    return repeated_keys(keyed, "key", "lang")


# -- statistics ---------------------------------------------------------------------------


@query
def avg_sim_to_others(spark, sf_dir):
    rows = stats.avg_sim_to_others(_members(spark, sf_dir))
    return rows.select("item_id", "cluster_id", _r("avg_sim_to_others").alias("avg_sim"))


@query
def extreme_sims(spark, sf_dir):
    rows = stats.extreme_sims(_members(spark, sf_dir))
    return rows.select(
        "item_id", "cluster_id", _r("max_sim").alias("max_sim"), _r("min_sim").alias("min_sim")
    )


@query
def extreme_sims_blocks(spark, sf_dir):
    rows = stats.extreme_sims(_members(spark, sf_dir), block=16)
    return rows.select(
        "item_id", "cluster_id", _r("max_sim").alias("max_sim"), _r("min_sim").alias("min_sim")
    )


@query
def extreme_sims_null_clusters(spark, sf_dir):
    rows = stats.extreme_sims(_some_without_cluster(spark, sf_dir), block=16)
    return rows.select(
        "item_id", "cluster_id", _r("max_sim").alias("max_sim"), _r("min_sim").alias("min_sim")
    )


@query
def avg_sim_null_clusters(spark, sf_dir):
    rows = stats.avg_sim_to_others(_some_without_cluster(spark, sf_dir))
    return rows.select("item_id", "cluster_id", _r("avg_sim_to_others").alias("avg_sim"))


@query
def pairwise_std(spark, sf_dir):
    rows = stats.pairwise_std(_members(spark, sf_dir))
    return rows.select("cluster_id", "cluster_size", _r("std_pair_sim").alias("std_pair_sim"))


@query
def pairwise_std_chunks(spark, sf_dir):
    rows = stats.pairwise_std(_members(spark, sf_dir), chunk=16)
    return rows.select("cluster_id", "cluster_size", _r("std_pair_sim").alias("std_pair_sim"))


@query
def centroid_cohesion(spark, sf_dir):
    rows = stats.centroid_cohesion(_measured(spark, sf_dir))
    return rows.select("cluster_id", _r("avg_sim_to_cent").alias("avg_sim"), _r("std_sim_to_cent").alias("std_sim"))


@query
def duplicate_report(spark, sf_dir):
    report = stats.duplicate_report(_pruned(spark, sf_dir), EPS)
    return report.withColumn("duplicates_ratio", _r("duplicates_ratio"))


@query
def eps_sweep(spark, sf_dir):
    sweep = stats.eps_sweep(_pruned(spark, sf_dir), EPS)
    return sweep.withColumn("kept_fraction", _r("kept_fraction"))


@query
def kept_count(spark, sf_dir):
    return stats.kept_count(_pruned(spark, sf_dir), 0.7)


@query
def prune_report_items(spark, sf_dir):
    items = prune_report(_ordered(spark, sf_dir), EPS)["items"]
    return items.select(
        "item_id",
        "cluster_id",
        names.eps_column(0.7),
        _r("avg_sim_to_others").alias("avg_sim"),
        _r("max_sim").alias("max_sim"),
        _r("min_sim").alias("min_sim"),
    )


@query
def report_resumed(spark, sf_dir):
    """A report that was stopped after some of its clusters and goes on with the others."""
    path = stage_path(spark, "report")
    ordered = _ordered(spark, sf_dir)
    write_report(ordered.where("cluster_id % 3 = 0"), path, EPS, block=16)
    items = write_report(ordered, path, EPS, block=16, ranges=2)["items"]
    return items.select(
        "item_id",
        "cluster_id",
        names.eps_column(0.7),
        _r("avg_sim_to_others").alias("avg_sim"),
        _r("max_sim").alias("max_sim"),
        _r("min_sim").alias("min_sim"),
    )


@query
def eps_for_kept(spark, sf_dir):
    """The eps that keeps a wanted share of the items."""
    sims = stage_table(prune.max_earlier_sim(_ordered(spark, sf_dir)), "sims")
    found = eps_of_fractions(sims, KEPT_FRACTIONS)
    return found.select("fraction", _r("eps").alias("eps"))


@query
def prune_report_clusters_in_parts(spark, sf_dir):
    """Statistics of clusters cut into parts: the spread is the mean over the parts."""
    parts = rank.split_clusters(_ordered(spark, sf_dir), 20)
    return prune_report(parts, EPS)["clusters"].select(
        "cluster_id",
        "cluster_size",
        _r("std_pair_sim").alias("std_pair_sim"),
        _r("avg_sim_to_cent").alias("avg_sim"),
        _r("std_sim_to_cent").alias("std_sim"),
    )


# -- samples and splits -------------------------------------------------------------------


@query
def sample_per_cluster(spark, sf_dir):
    return sampling.sample_per_cluster(_length_classes(spark, sf_dir), 3, SEED)


@query
def preview(spark, sf_dir):
    """The dataset lacks some items: documents without a quality label are placeholders."""
    members = _length_classes(spark, sf_dir).withColumn("dist", F.lit(0.5))
    dataset = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id")
    return sampling.preview(members, dataset, n_clusters=5, per_cluster=9, seed=SEED)


@query
def train_test_split(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id")
    return sampling.train_test_split(documents, 0.8, SEED, id_col="doc_id")


@query
def train_test_split_exact(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id")
    return sampling.train_test_split(documents, 0.8, SEED, id_col="doc_id", exact=True)


@query
def head_subset(spark, sf_dir):
    return readers.head_subset(_table(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id", "lang")


@query
def accuracy(spark, sf_dir):
    """``quality`` read as the prediction of ``toxic``, by split and epoch."""
    labels = sampling.train_test_split(_table(spark, sf_dir, "labels"), 0.8, SEED, id_col="doc_id")
    predictions = labels.select(
        F.lit("full").alias("run"),
        (F.col("doc_id") % 10).alias("epoch"),
        F.col("split").alias("phase"),
        F.col("quality").alias("pred"),
        F.col("toxic").alias("label"),
    )
    return evaluate.accuracy(predictions).withColumn("accuracy", _r("accuracy"))


# -- keys, names, files -------------------------------------------------------------------


@query
def output_names(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return labels.select(
        "doc_id",
        names.output_name("doc_id").alias("plain"),
        names.output_name("doc_id", "quality").alias("labelled"),
        names.output_name("doc_id", pattern="img-{}.png").alias("patterned"),
    )


@query
def label_from_name(spark, sf_dir):
    named = _table(spark, sf_dir, "labels").select(
        "doc_id", names.output_name("doc_id", "quality").alias("name")
    )
    return named.withColumn("label", names.label_from_name("name"))


@query
def normalize_ext(spark, sf_dir):
    """The words after the last dot of each url are the candidates."""
    ext = F.substring_index("url", ".", -1)
    upper = F.when(F.col("url").contains(".org/"), F.lit("PNG")).otherwise(ext)
    return _table(spark, sf_dir, "pages").select("page_id", names.normalize_ext(upper).alias("ext"))


@query
def truncate_keys(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(
        "page_id",
        names.truncate_key("url", 24).alias("stored"),
        names.truncate_key("url", 32).alias("exported"),
        names.base_name("url").alias("base"),
    )


@query
def decode_keys(spark, sf_dir):
    padded = F.concat(F.encode("url", "utf-8"), F.unhex(F.lit("000000")))
    return _table(spark, sf_dir, "pages").select("page_id", names.decode_key(padded).alias("key"))


def _files(spark, sf_dir):
    """Source files: one per labelled document, numbered by name."""
    labels = _table(spark, sf_dir, "labels")
    return readers.number_files(labels.select(names.output_name("doc_id").alias("name")))


@query
def number_files(spark, sf_dir):
    return _files(spark, sf_dir)


@query
def list_files(spark, sf_dir):
    """The files of a table that was written in partitions, one file each."""
    path = stage_path(spark, "files")
    labels = _table(spark, sf_dir, "labels").repartition("quality", "toxic")
    labels.write.partitionBy("quality", "toxic").parquet(path)
    return readers.list_source_files(spark, path, ".parquet").select("file_no")


@query
def resolve_files(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    ids = documents.select(F.col("doc_id").cast("string").alias("id")).unionByName(
        documents.select(F.concat(F.lit("image_"), F.col("doc_id").cast("string")).alias("id"))
    )
    return gather.resolve_files(ids, _files(spark, sf_dir), pattern="image_{}.jpg")


@query
def keep_documents(spark, sf_dir):
    kept = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = gather.keep_items(_table(spark, sf_dir, "documents"), kept, id_col="doc_id")
    return rows.select("doc_id", "lang", "n_chars", "image_path")


@query
def missing_ids(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id")
    return gather.missing_ids(documents, _table(spark, sf_dir, "labels"), id_col="doc_id")


@query
def attach_embeddings(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).select("item_id", "cluster_id", "pos")
    rows = gather.attach_embeddings(ranked, _members(spark, sf_dir))
    return rows.select("item_id", "cluster_id", "pos", _r(vectors.squared_norm("embedding")).alias("norm2"))


@query
def attach_keys(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).withColumn("path", names.output_name("item_id", "cluster_id"))
    rows = gather.attach_keys(_pruned(spark, sf_dir), ranked)
    return rows.select("item_id", "cluster_id", "path", names.eps_column(0.7))


def _manifest(spark, sf_dir):
    """Pages as the things to fetch, those without TLS taken as having no url; files of
    labelled documents are there already."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("url").startswith("https:"), F.col("url")).alias("url"), F.lit("JPG").alias("ext")
    )
    existing = _table(spark, sf_dir, "labels").select(names.output_name("doc_id").alias("name"))
    return manifest.fetch_manifest(pages, existing, id_col="page_id", ext_col="ext")


@query
def fetch_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query
def manifest_counts(spark, sf_dir):
    return manifest.manifest_counts(_manifest(spark, sf_dir))


# -- written and read back ----------------------------------------------------------------


@query
def read_embeddings(spark, sf_dir):
    rows = readers.read_embeddings(spark, f"{sf_dir}/embeddings.parquet", "vec_id", dim=64)
    return rows.select("item_id", F.size("embedding").alias("dim"))


@query
def written_sorted_clusters(spark, sf_dir):
    path = stage_path(spark, "sorted")
    ranked = _ranked(spark, sf_dir).withColumn("path", names.output_name("item_id"))
    writers.write_sorted(ranked, path, "tsv", buckets=4)
    rows = readers.read_sorted_clusters(spark, path, columns=4)
    return rows.select("item_id", "path", "cluster_id", _r("dist").alias("dist"))


@query
def written_id_list(spark, sf_dir):
    path = stage_path(spark, "ids")
    kept = prune.select_pruned(_pruned(spark, sf_dir), 0.7)
    writers.write_id_list(kept.select(F.col("item_id").alias("path")), path)
    return readers.read_id_list(spark, path)


@query
def written_dataset(spark, sf_dir):
    """A split dataset with a binary column; the reader takes the training split."""
    path = stage_path(spark, "dataset")
    pages = sampling.train_test_split(_table(spark, sf_dir, "pages"), 0.8, SEED, id_col="page_id")
    writers.write_dataset(pages.withColumn("html", F.encode("html", "utf-8")), path)
    rows = readers.read_dataset(spark, path)
    return rows.select("page_id", "url", F.md5("html").alias("payload"))


@query
def raw_matrix(spark, sf_dir):
    """Vectors written by tasks as headerless files, and read back by row number."""
    path = stage_path(spark, "raw")
    members = _members(spark, sf_dir)
    raw.write_raw(members, path, "item_id", "embedding")
    dim = members.agg(F.max(F.size("embedding"))).first()[0]
    return _elements(readers.read_raw_matrix(spark, path, dim), "item_id", "embedding")


@query
def raw_keys(spark, sf_dir):
    """The same for keys of a fixed width."""
    path = stage_path(spark, "raw-keys")
    key = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("-é"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", key.alias("path"))
    raw.write_raw(docs.where("path IS NOT NULL"), path, "doc_id", "path", names.STORED_KEY_WIDTH)
    return readers.read_raw_keys(spark, path)


@query
def written_clusters(spark, sf_dir):
    path = stage_path(spark, "clusters")
    centroids = _centroids(spark, sf_dir)
    writers.write_clusters(assign(_members(spark, sf_dir), centroids), centroids, path)
    found = spark.read.parquet(f"{path}/assignments")
    return found.select("item_id", "cluster_id", _r("score").alias("score"))


@query
def reused_assignments(spark, sf_dir):
    """Centroids and assignments computed once, then taken from where they were saved."""
    path = stage_path(spark, "reuse")
    members = _members(spark, sf_dir)
    for _ in range(2):
        centroids = load_or_fit(f"{path}/centroids", members, mean_centroids)
        found = load_or_assign(f"{path}/assignments", members, centroids)
    return found.select("item_id", "cluster_id", _r("score").alias("score"))


@query
def written_ranked_members(spark, sf_dir):
    path = stage_path(spark, "ranked")
    writers.write_ranked_members(_length_classes(spark, sf_dir), path, buckets=8)
    return spark.read.parquet(path).select("item_id", "cluster_id", "size_rank")


@query
def written_size_list(spark, sf_dir):
    path = stage_path(spark, "summary")
    writers.write_summary(_length_classes(spark, sf_dir), path)
    schema = "cluster_id int, cluster_size bigint"
    return spark.read.csv(f"{path}/clusters_by_size", sep="\t", schema=schema)


def _written(spark, sf_dir, table):
    path = stage_path(spark, "stats")
    report = prune_report(_ordered(spark, sf_dir), EPS)
    writers.write_stats(report["items"], report["clusters"], report["eps_report"], path)
    return spark.read.parquet(f"{path}/{table}")


@query
def written_stats(spark, sf_dir):
    rows = _written(spark, sf_dir, "eps_report")
    return rows.withColumn("duplicates_ratio", _r("duplicates_ratio"))


@query
def written_item_stats(spark, sf_dir):
    return _written(spark, sf_dir, "items").select(
        "item_id",
        "cluster_id",
        names.eps_column(0.7),
        _r("avg_sim_to_others").alias("avg_sim"),
        _r("max_sim").alias("max_sim"),
        _r("min_sim").alias("min_sim"),
    )


@query
def written_cluster_stats(spark, sf_dir):
    return _written(spark, sf_dir, "clusters").select(
        "cluster_id", "cluster_size", _r("avg_sim_to_cent").alias("avg_sim"), _r("std_sim_to_cent").alias("std_sim")
    )


@query
def written_summary(spark, sf_dir):
    path = stage_path(spark, "summary")
    writers.write_summary(_length_classes(spark, sf_dir), path)
    schema = "n_clusters bigint, max_size bigint, min_size bigint, mean_size double, n_singletons bigint"
    rows = spark.read.csv(f"{path}/summary", sep="\t", schema=schema, header=True)
    return rows.withColumn("mean_size", _r("mean_size"))


@query
def written_histogram(spark, sf_dir):
    path = stage_path(spark, "summary")
    writers.write_summary(_length_classes(spark, sf_dir), path)
    return spark.read.csv(f"{path}/histogram", sep="\t", schema="size_bin int, n_clusters bigint")


@query
def resolved_columns(spark, sf_dir):
    """The id under one of its usual names, the payload found by a part of its name."""
    pages = _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("idx"), F.col("url").alias("My_Image_Url")
    )
    image = readers.image_column(pages)
    return readers.with_item_id(pages).select("item_id", F.col(image).alias("image"))


# -- encoding and whole jobs --------------------------------------------------------------


@query
def hash_encode(spark, sf_dir):
    encoded = encode.hash_encoder(_texts(spark, sf_dir).select("doc_id", "text"))
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("i", "value"))
    return cells.where("value > 0").select(
        "doc_id", F.col("i").cast("bigint").alias("i"), _r("value").alias("value")
    )


def _count_encoder():
    """An encoder for demonstration: characters, blanks, and a constant."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" "), 1.0] for t in texts])


@query
def embed_documents(spark, sf_dir):
    documents = _texts(spark, sf_dir)
    return _elements(encode.embed(documents, "doc_id", "text", _count_encoder), "doc_id", "embedding")


def _language_clusters(spark, sf_dir):
    documents = _texts(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "lang", "text")
    return stage_table(encode.hash_encoder(documents, normalize=False).drop("text"), "encoded")


@query
def dedup_documents_by_lang(spark, sf_dir):
    """The clusters are texts, the languages themselves."""
    options = DedupOptions(eps_list=DOC_EPS)
    pruned = dedup_given_clusters(_language_clusters(spark, sf_dir), options, cluster_col="lang").rows
    kept = prune.select_pruned(pruned, 0.05).select(F.col("item_id").alias("doc_id"))
    documents = _table(spark, sf_dir, "documents")
    return gather.keep_items(documents, kept, id_col="doc_id", path_col=None).select("doc_id", "lang", "n_chars")


@query
def dedup_from_given_centroids(spark, sf_dir):
    """The whole job on vectors with training that starts from the label means, so that it
    has an exact answer."""
    items = _members(spark, sf_dir).drop("cluster_id")
    options = DedupOptions(eps_list=EPS, seed=SEED)
    centroids = lloyd(items, _centroids(spark, sf_dir), 2)
    pruned = prune_clusters(cluster_items(items, options, centroids), options)
    return prune.select_pruned(pruned, 0.7).select("item_id", "cluster_id")


@query
def dedup_full(spark, sf_dir):
    options = DedupOptions(k=8, niter=2, seed=SEED, eps_list=DOC_EPS)
    kept = dedup(_texts(spark, sf_dir), options, id_col="doc_id", eps=0.05).rows
    return kept.select("doc_id", "lang", "n_chars")
