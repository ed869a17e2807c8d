"""Archives: the query against its SQL twin, round trips of cut payloads, damage."""

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from vecprune.llm import warc

TRICKY = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
ROWS = [
    (1, "u", None), (2, None, ""), (None, "a b\r\nX: y", "abc"), (3, "v", "abc"), (3, "v", "abc"), (None, "w", "abc"),
    (5, "é%", TRICKY * 5000), (6, "z", TRICKY * 5000), (7, "big", "\r\n" * 300_001), (8, "q", "WARC/1.1\r\n"),
    (9, "q", "x" * 65_536), (10, "q", "x" * 65_537), (None, "n", None), (-4, "x\x00y", "\x00"), (11, "", "\r\n"),
]
SCHEMA = "page_id long, url string, html string, row long, id string, payload string, print long, chunk string, last long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    rows = [(*r, 1, "i", "p", 2, "c", 3) for r in ROWS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


def test_query(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert compare.differences(warc.op12_warc(spark, folder), con, warc.OP12_SQL) == []


@pytest.mark.parametrize("chunk, compression", [(1, "none"), (7, "gzip"), (1 << 16, "none")])
def test_payloads_come_back(spark, tmp_path, chunk, compression):
    rows = [(i, u, (h or "")[:200]) for i, u, h in ROWS]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path), least=1 << 40, chunk=chunk, compression=compression)
    chunks = warc.read_archives(spark, path)
    assert chunks.filter(F.octet_length("data") > chunk).count() == 0
    back = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.record, r.chunk)):
        assert r.chunk == len(back.setdefault(r.record, []))
        back[r.record].append((r.id, bytes(r.data)))
    got = sorted((str(v[0][0]), b"".join(d for _, d in v)) for v in back.values())
    assert got == sorted((str(i), h.encode()) for i, _, h in rows)
    records = warc.read_records(chunks)
    assert {r.type for r in records.collect()} == {"response"} and records.count() == len(rows)


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", t) for i in (1, 2, 3) for t in ("ab", "abc")], "page_id long, url string, html string")
    records = warc.read_records(warc.read_archives(spark, warc.write_archives(pages, str(tmp_path), least=3)))
    found = sorted((r.n_bytes, r.id, r.type, r.refers_to) for r in records.collect())
    assert found[:3] == [(2, str(i), "response", None) for i in (1, 2, 3)]
    assert found[3:] == [(3, "1", "revisit", "3"), (3, "2", "revisit", "3"), (3, "3", "response", None)]


def test_archives_are_valid_records(spark, tmp_path):
    """Files read by the format alone: a version line, fields, a blank line, so many bytes, two breaks."""
    pages = spark.createDataFrame([(i, u, (h or "")[:99]) for i, u, h in ROWS], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path), chunk=50, compression="none")
    n = 0
    for file in tmp_path.rglob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].split(b"\r\n")
            assert lines[0] == b"WARC/1.1" and all(b": " in x for x in lines[1:])
            size = int(dict(x.split(b": ", 1) for x in lines[1:])[b"Content-Length"])
            at = end + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at, n = at + 4, n + 1
    assert n > len(ROWS)


@pytest.mark.parametrize("damage", ["cut", "changed", "missing"])
def test_damage_is_told(spark, tmp_path, damage):
    pages = spark.createDataFrame([(1, "u", "abcdefgh" * 100)], "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path), chunk=300, compression="none")
    if damage == "missing":
        chunks = warc.read_archives(spark, path).filter("chunk <> 1")
    else:
        file = next(f for f in tmp_path.rglob("part-*") if f.stat().st_size)
        data = file.read_bytes()
        file.with_name("." + file.name + ".crc").unlink(missing_ok=True)
        file.write_bytes(data[:-40] if damage == "cut" else data.replace(b"hab", b"hxb", 1))
        chunks = warc.read_archives(spark, path)
    with pytest.raises(Exception, match="damaged archive"):
        warc.read_records(chunks).collect()
