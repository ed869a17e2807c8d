"""Round trips through files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecprune.operators.assign import assign, load_or_assign
from vecprune.operators.kmeans import load_or_fit, mean_centroids
from vecprune.operators.gather import resolve_files
from vecprune.operators.prune import prune_table
from vecprune.operators.rank import order_policy, rank_within_cluster
from vecprune.sources import raw, readers, writers


@pytest.fixture(scope="module")
def ranked(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i, f"img {i}", int(i % 3), rng.normal(size=4).astype("f4").tolist(), float(rng.random()))
        for i in range(40)
    ]
    schema = "item_id long, path string, cluster_id int, embedding array<float>, dist double"
    return order_policy(rank_within_cluster(spark.createDataFrame(rows, schema))).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_raw_matrix_and_keys(spark, tmp_path):
    matrix = np.arange(3000, dtype="<f4").reshape(1000, 3) / 7
    matrix.tofile(tmp_path / "emb.npy")
    keys = [f"klíč {i}" if i % 2 else str(i) for i in range(1000)]
    (tmp_path / "keys.npy").write_bytes(b"".join(k.encode().ljust(24, b"\0") for k in keys))
    vectors = readers.read_raw_matrix(spark, str(tmp_path / "emb.npy"), 3)
    named = vectors.join(readers.read_raw_keys(spark, str(tmp_path / "keys.npy")), "item_id")
    got = {r.item_id: (r.path, r.embedding) for r in named.collect()}
    assert len(got) == 1000
    for i in (0, 1, 499, 999):
        assert got[i] == (keys[i], [float(x) for x in matrix[i]])


def test_raw_files_in_ranges(spark, tmp_path):
    """Ranges and batches of a few records, in a folder whose files follow each other by name."""
    matrix = np.arange(300, dtype="<f4").reshape(100, 3)
    for name, part in (("b", matrix[:33]), ("c", matrix[33:34]), ("d", matrix[34:34]), ("e", matrix[34:])):
        part.tofile(tmp_path / name)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    df = readers.read_raw_matrix(spark, str(tmp_path), 3, partition_bytes=40)
    assert df.rdd.getNumPartitions() >= 30
    assert rows_of(df) == [(i, row.tolist()) for i, row in enumerate(matrix)]
    assert raw.FixedWidthReader(str(tmp_path), 12, 3, 40).partitions()[11] == raw.RecordRange(str(tmp_path / "c"), 0, 33, 1)


def test_truncated_and_empty_raw_files(spark, tmp_path):
    (tmp_path / "cut").write_bytes(b"\0" * 25)
    with pytest.raises(Exception, match="25 bytes, which is no multiple"):
        readers.read_raw_matrix(spark, str(tmp_path / "cut"), 3).collect()
    (tmp_path / "none").write_bytes(b"")
    assert readers.read_raw_matrix(spark, str(tmp_path / "none"), 3).collect() == []
    with pytest.raises(Exception, match="there is no"):
        readers.read_raw_keys(spark, str(tmp_path / "absent")).collect()


def test_raw_files_are_written_in_order(spark, tmp_path):
    rows = [(i, [float(i), -1.0], f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v array<double>, k string").repartition(6)
    assert raw.write_raw(df, str(tmp_path / "m"), "id", "v") == 500
    assert rows_of(readers.read_raw_matrix(spark, str(tmp_path / "m"), 2)) == [(i, v) for i, v, _ in rows]
    assert raw.write_raw(df, str(tmp_path / "k"), "id", "k", 6) == 500
    assert rows_of(readers.read_raw_keys(spark, str(tmp_path / "k"), 6)) == [(i, k) for i, _, k in rows]
    with pytest.raises(Exception, match="longer than 3 bytes"):
        raw.write_raw(df, str(tmp_path / "x"), "id", "k", 3)


def test_undecodable_keys_are_kept(spark, tmp_path):
    (tmp_path / "keys").write_bytes(b"caf\xe9\0\0ok\0\0\0\0")
    keys = readers.read_raw_keys(spark, str(tmp_path / "keys"), width=6)
    assert rows_of(keys) == [(0, "café"), (1, "ok")]


def test_embeddings_are_checked(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "k int, v array<float>").write.parquet(path)
    assert readers.read_embeddings(spark, path, "k", "v").columns == ["item_id", "embedding"]
    with pytest.raises(ValueError, match="1 vectors"):
        readers.read_embeddings(spark, path, "k", "v", dim=2)


def test_split_choice(spark, tmp_path):
    data = spark.createDataFrame([(1, "test"), (2, "train"), (3, "dev")], "id long, split string")
    with_train, without = str(tmp_path / "a"), str(tmp_path / "b")
    writers.write_dataset(data, with_train)
    writers.write_dataset(data.where("split <> 'train'"), without)
    assert [r.id for r in readers.read_dataset(spark, with_train).collect()] == [2]
    assert [r.id for r in readers.read_dataset(spark, without).collect()] == [3]
    assert [r.id for r in readers.read_dataset(spark, with_train, "test").collect()] == [1]
    with pytest.raises(ValueError):
        readers.read_dataset(spark, without, "train")


def test_binary_payload_survives(spark, tmp_path):
    data = spark.createDataFrame([(1, bytearray(b"\x00\xff")), (2, None)], "item_id long, image binary")
    writers.write_dataset(data, str(tmp_path / "d"))
    assert rows_of(spark.read.parquet(str(tmp_path / "d"))) == [(1, bytearray(b"\x00\xff")), (2, None)]


def test_sorted_clusters_as_text(spark, tmp_path):
    (tmp_path / "sorted_cluster_12.txt").write_text('5\ta "b"\t0.25\n3\tc\t0.5\n')
    (tmp_path / "sorted_cluster_7.txt").write_text("9\td\t1.5\n")
    (tmp_path / "notes.txt").write_text("x\n")
    rows = readers.read_sorted_clusters(spark, str(tmp_path))
    assert rows_of(rows) == [(3, "c", 0.5, 12), (5, 'a "b"', 0.25, 12), (9, "d", 1.5, 7)]
    two = tmp_path / "two"
    two.mkdir()
    (two / "cluster_0.txt").write_text("4\t0.5\n")
    assert rows_of(readers.read_sorted_clusters(spark, str(two), columns=2)) == [(4, None, 0.5, 0)]


@pytest.mark.parametrize("fmt", ["parquet", "tsv"])
def test_write_sorted(spark, ranked, tmp_path, fmt):
    path = str(tmp_path / fmt)
    ranked = ranked.withColumn("path", F.concat(F.lit('"a\\ '), "path", F.lit('"')))
    writers.write_sorted(ranked, path, fmt, buckets=2)
    if fmt == "parquet":
        back = spark.read.parquet(path).select("item_id", "path", "dist", "cluster_id")
    else:
        back = readers.read_sorted_clusters(spark, path, columns=4)
    assert rows_of(back) == rows_of(ranked.select("item_id", "path", "dist", "cluster_id"))


def test_id_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("  7 \n\nabc\n\t12\r\n-3\n")
    path = str(tmp_path / "ids.txt")
    assert rows_of(readers.read_id_list(spark, path)) == [(7,), (12,)]
    texts = readers.read_id_list(spark, path, numeric_only=False)
    assert rows_of(texts) == [("-3",), ("12",), ("7",), ("abc",)]


def test_key_list(spark, ranked, tmp_path):
    writers.write_id_list(ranked, str(tmp_path / "full"))
    back = readers.read_id_list(spark, str(tmp_path / "full"), numeric_only=False)
    assert rows_of(back) == sorted((f"img {i}",) for i in range(40))
    long_key = spark.createDataFrame([("x" * 40,)], "path string")
    writers.write_id_list(long_key, str(tmp_path / "short"), shorten=True)
    assert spark.read.text(str(tmp_path / "short")).first()[0] == "x" * 32


def test_file_listing(spark, tmp_path):
    for name in ("b.JPG", "a.jpg", "c.png", "image_9.jpg"):
        (tmp_path / name).write_bytes(b"x")
    files = readers.list_source_files(spark, str(tmp_path))
    assert rows_of(files.select("file_no", "name")) == [(0, "a.jpg"), (1, "b.JPG"), (2, "image_9.jpg")]


def test_columns_are_found(spark):
    df = spark.createDataFrame([(1, 2, 3)], "My_IMAGE_data int, idx int, other int")
    assert readers.image_column(df) == "My_IMAGE_data"
    assert readers.with_item_id(df).first().item_id == 2
    assert readers.resolve_column(df, ["nothing"]) is None
    with pytest.raises(ValueError):
        readers.image_column(df.select("other"))
    plain = spark.range(10).select(F.col("id").cast("string").alias("name")).coalesce(1)
    assert {r.name: r.item_id for r in readers.with_item_id(plain).collect()} == {
        str(i): i for i in range(10)
    }


def test_pruning_resumes_without_redoing(spark, ranked, tmp_path):
    path = str(tmp_path / "pruned")
    seen = []

    def prune(rows):
        seen.append({r.cluster_id for r in rows.select("cluster_id").distinct().collect()})
        return prune_table(rows, [0.3])

    writers.write_pruning(ranked.where("cluster_id = 1"), path, prune)
    writers.write_pruning(ranked, path, prune, ranges=2)
    assert seen == [{1}, {0}, {2}]
    whole = prune_table(ranked, [0.3]).select("item_id", "cluster_id", "eps_0_3")
    # Rows of a step that failed before its marker don't count, and their clusters are redone.
    stale = prune_table(ranked, [0.3]).withColumn("_run", F.lit("failed"))
    stale.write.mode("append").parquet(f"{path}/rows")
    writers.write_pruning(ranked, path, prune)
    assert seen[3] == set()
    back = writers.read_pruning(spark, path).select("item_id", "cluster_id", "eps_0_3")
    assert rows_of(back) == rows_of(whole)


def test_id_list_with_long_numbers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("7\n99999999999999999999\n\n x \n 12 \n")
    ids = readers.read_id_list(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.item_id for r in ids.collect()) == [7, 12]


def test_files_of_one_name_are_one_source(spark):
    ids = spark.createDataFrame([("a.jpg",)], "id string")
    files = spark.createDataFrame([(0, "a.jpg"), (1, "a.jpg")], "file_no long, name string")
    assert [r.status for r in resolve_files(ids, files).collect()] == ["found"]


def test_saved_centroids_and_assignments_are_reused(spark, ranked, tmp_path):
    calls = []

    def fit(df):
        calls.append(1)
        return mean_centroids(df)

    cents = load_or_fit(str(tmp_path / "c"), ranked, fit)
    again = load_or_fit(str(tmp_path / "c"), ranked, fit)
    assert len(calls) == 1 and rows_of(cents) == rows_of(again)
    items = ranked.select("item_id", "embedding")
    first = load_or_assign(str(tmp_path / "a"), items, cents)
    other = load_or_assign(str(tmp_path / "a"), items, cents.limit(1))
    columns = ["item_id", "cluster_id", "score"]
    assert rows_of(first.select(columns)) == rows_of(other.select(columns))
    assert rows_of(first.select(columns)) == rows_of(assign(items, cents).select(columns))


def test_summary_files(spark, ranked, tmp_path):
    path = str(tmp_path / "s")
    writers.write_summary(ranked, path)
    sizes = spark.read.csv(f"{path}/clusters_by_size", sep="\t", schema="c int, n long")
    assert rows_of(sizes) == [(0, 14), (1, 13), (2, 13)]
    summary = spark.read.csv(f"{path}/summary", sep="\t", header=True, inferSchema=True).first()
    assert (summary.n_clusters, summary.max_size, summary.min_size) == (3, 14, 13)


def test_remaining_sinks(spark, ranked, tmp_path):
    path = str(tmp_path)
    writers.write_ranked_members(ranked.select("item_id", "cluster_id"), f"{path}/r", buckets=2)
    members = spark.read.parquet(f"{path}/r")
    assert {(r.cluster_id, r.size_rank) for r in members.collect()} == {(0, 0), (1, 1), (2, 2)}
    writers.write_clusters(ranked.select("item_id", "cluster_id"), mean_centroids(ranked), f"{path}/k")
    assert spark.read.parquet(f"{path}/k/assignments").count() == 40
    assert spark.read.parquet(f"{path}/k/centroids").count() == 3
    one = spark.range(1)
    writers.write_stats(one, one, one, f"{path}/st")
    assert spark.read.parquet(f"{path}/st/eps_report").count() == 1
