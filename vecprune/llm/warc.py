"""WARC archives as a chunked record table.

*Writing.*  Payloads are digested once into a stage table.  Of equal payloads of at least
``least`` bytes the one with the largest id becomes a response, the others become revisit
records without a payload that refer to it.  A payload of more than ``chunk`` bytes is cut:
its record holds the first chunk, and continuation records (segments, in the words of the
format) hold the others.  So a row of the writer never carries more than a chunk, and Spark's
own text writer commits the files.

*Reading.*  Every record starts with the version and the archive's random id, a line that no
payload written before the id was drawn can hold.  Spark's text reader cuts the files there,
and large files are split.  A row is a record header and one chunk: ``(record, chunk, data)``.
Chunks of a cut record are brought together in order and stream through an incremental
digest; no task ever holds a whole record.  The digest and the length of what was read must
be those of the header, and a chunk must not be missing.

Defined results: a NULL payload is an empty one; a NULL id stays NULL and ranks below all
others; of repeated rows with one id and payload one is the response, the others revisit it; a
NULL url gives a record without a target; line breaks and blanks in a url are
percent-encoded; an empty table gives archives without records; other columns play no part.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecprune.llm.lookup import look_up
from vecprune.session import ship_package
from vecprune.staging import stage_path, stage_table

CHUNK = 1 << 16
BROADCAST_ROWS = 1 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """The base32 form of a SHA-1 digest in hexadecimal digits: 8 digits from each 40 bits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_table(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """``row, id, url, payload, n_bytes, digest, original, original_id``: a record per row.

    ``original`` is the row of the response that holds the payload, NULL for responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).select(
        F.monotonically_increasing_id().alias("row"),
        "*",
        F.octet_length("payload").cast("long").alias("n_bytes"),
        base32(F.sha1("payload")).alias("digest"),
        F.unhex(F.sha2("payload", 256)).alias("print"),
    )
    records = stage_table(records, "warc-records")
    long_enough = records.filter(F.col("n_bytes") >= least)
    groups = long_enough.groupBy("print").agg(F.max(F.struct("id", "row")).alias("first"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").select(
        "print", F.col("first.row").alias("original"), F.col("first.id").alias("original_id"), "n"
    )
    groups = stage_table(groups, "warc-groups")
    revisits = look_up(long_enough.select("row", "print"), groups, "print", "n")
    revisits = stage_table(revisits.filter("original <> row").drop("print"), "warc-revisits")
    # Payloads are shuffled only if the revisits are too many to broadcast.
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    return records.drop("print").join(side, "row", "left")


def _field(name: str, *value: Column | str) -> Column:
    """A header line, or nothing if a part of the value is NULL."""
    parts = [F.lit(v) if isinstance(v, str) else v.cast("string") for v in value]
    return F.coalesce(F.concat(F.lit(f"{name}: "), *parts, F.lit("\r\n")), F.lit(""))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 0,
    chunk: int = CHUNK,
    date: datetime.datetime | None = None,
    compression: str = "gzip",
) -> str:
    """Write a record per row of ``pages`` below ``path``; returns the archives' folder.

    The folder's name is the archives' id.  ``compression`` is one of Spark's text writer.
    """
    records = record_table(pages, id_col, url_col, payload_col, least)
    # Drawn when all payloads are staged, so that no payload can hold it.
    archive = str(uuid.uuid4())
    moment = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("original").isNotNull()
    last = F.when(revisit, 0).otherwise(F.floor((F.greatest("n_bytes", F.lit(1)) - 1) / chunk)).cast("int")
    pieces = records.withColumn("last", last).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk")
    )
    first, cut = F.col("chunk") == 0, F.col("last") > 0
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    head = F.when(first, http).otherwise("").cast("binary")
    start = (F.col("chunk").cast("long") * chunk + 1).cast("int")
    data = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", start, F.lit(chunk)))
    block = F.concat(head, data)
    name = f"<urn:warc:{archive}:"
    segment = F.when(cut, F.col("chunk") + 1)
    url = F.regexp_replace(F.regexp_replace("url", r"[\r\n]+", "%0A"), r"[\x00-\x20]", "%20")
    header = F.concat(
        F.lit(f"{VERSION}\r\n{_first_line(archive)}\r\n"),
        _field("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", name, F.col("row"), F.when(first, "").otherwise(F.concat(F.lit(":"), segment)), ">"),
        _field("WARC-Date", moment),
        _field("WARC-Target-URI", url),
        _field("X-Item-ID", F.url_encode(F.col("id").cast("string"))),
        _field("WARC-Payload-Digest", "sha1:", F.col("digest")),
        _field("X-Payload-Length", F.col("n_bytes")),
        _field("WARC-Segment-Number", segment),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.concat(F.lit(name), "row", F.lit(">")))),
        _field("WARC-Segment-Total-Length", F.when(cut & (F.col("chunk") == F.col("last")), F.col("n_bytes"))),
        _field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _field("WARC-Refers-To", F.when(revisit, F.concat(F.lit(name), "original", F.lit(">")))),
        _field("X-Refers-To-Item-ID", F.when(revisit, F.url_encode(F.col("original_id").cast("string")))),
        _field("Content-Type", HTTP_TYPE),
        _field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    # The writer ends each row by a line break more, which makes the two after a block.
    value = F.concat(header.cast("binary"), block, F.lit(b"\r\n")).cast("string").alias("value")
    folder = f"{path}/{archive}"
    pieces.select(value).write.option("lineSep", "\r\n").option("compression", compression).text(folder)
    return folder


def _first_line(archive: str) -> str:
    return f"WARC-Warcinfo-ID: <urn:uuid:{archive}>"


CHUNK_SCHEMA = (
    "record string, chunk int, type string, id string, digest string, n_bytes long, refers_to string, data binary"
)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The chunked record table: a row per record and chunk of the archives in ``folder``.

    ``chunk`` counts from 0; ``n_bytes`` and ``digest`` are those the header states of the
    whole payload, ``id`` and ``refers_to`` the ids of the record's and its response's rows.
    """
    ship_package(spark)
    archive = folder.rstrip("/").rsplit("/", 1)[1]
    start = f"{VERSION}\r\n{_first_line(archive)}\r\n"
    schema = pa.schema(
        [
            ("record", pa.string()), ("chunk", pa.int32()), ("type", pa.string()), ("id", pa.string()),
            ("digest", pa.string()), ("n_bytes", pa.int64()), ("refers_to", pa.string()), ("data", pa.binary()),
        ]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for value in batch.column(0) for row in parse(value.as_buffer(), start)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    lines = spark.read.option("lineSep", start).text(folder)
    return lines.filter("value <> ''").select(F.col("value").cast("binary").alias("value")).mapInArrow(kernel, CHUNK_SCHEMA)


_HEADER_END = re.compile(rb"\r\n\r\n")


def parse(value, start: str) -> Iterator[dict]:
    """Chunk rows of the records in a piece of an archive, the first of them without its start."""
    view, at = memoryview(value), 0
    while at < len(view):
        end = _HEADER_END.search(view, at)
        if end is None:
            raise ValueError("damaged archive: a record without the end of its header")
        lines = bytes(view[at : end.start()]).decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines if ": " in line)
        block = view[end.end() : end.end() + int(fields["Content-Length"])]
        if len(block) < int(fields["Content-Length"]):
            raise ValueError(f"damaged archive: record {fields['WARC-Record-ID']} is cut off")
        segment = int(fields.get("WARC-Segment-Number", 1))
        if segment == 1:
            body = _HEADER_END.search(block)
            data = block[body.end() :]
        else:
            data = block
        yield {
            "record": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]),
            "chunk": segment - 1,
            "type": fields["WARC-Type"],
            "id": _decoded(fields.get("X-Item-ID")),
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "n_bytes": int(fields["X-Payload-Length"]),
            "refers_to": _decoded(fields.get("X-Refers-To-Item-ID")),
            "data": bytes(data),
        }
        # Two line breaks end a record.  Then there is nothing, or a start that the reader missed.
        at = end.end() + len(block) + 4
        if bytes(view[at : at + len(start)]) == start.encode():
            at += len(start)
        elif at < len(view):
            raise ValueError("damaged archive: bytes between two records")


def _decoded(value: str | None) -> str | None:
    return None if value is None else urllib.parse.unquote_plus(value)


def running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's row with the bytes and the SHA-1 of its record up to its end.

    Chunks of a record must follow each other in order.  Memory is that of a batch.
    """
    record, state, done, expected = None, hashlib.sha1(), 0, 0
    for batch in batches:
        n, digests = [], []
        for name, chunk, data in zip(batch.column("record").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data")):
            if name != record:
                record, state, done, expected = name, hashlib.sha1(), 0, 0
            if chunk != expected:
                raise ValueError(f"damaged archive: chunk {expected} of record {name} is missing")
            buffer = data.as_buffer()
            state.update(buffer)
            done += buffer.size
            expected += 1
            n.append(done)
            digests.append(base64.b32encode(state.digest()).decode())
        columns = {c: batch.column(c) for c in batch.schema.names if c != "data"}
        columns |= {"n_read": pa.array(n, pa.int64()), "digest_read": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


READ_SCHEMA = CHUNK_SCHEMA.replace("data binary", "n_read long, digest_read string")


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunked record table, its payload's length and digest checked.

    Columns: ``record, type, id, n_bytes, digest, refers_to``.
    """
    whole = (F.col("type") != "continuation") & (F.octet_length("data") >= F.col("n_bytes"))
    simple = (F.col("type") == "revisit") | whole
    # One pass over the archives: of a record in one piece only the digest goes on.
    digest = F.when(F.col("type") == "response", base32(F.sha1("data")))
    parts = stage_table(
        chunks.withColumn("digest_read", F.when(simple, digest))
        .withColumn("n_read", F.octet_length("data").cast("long"))
        .withColumn("simple", simple)
        .withColumn("data", F.when(~simple, F.col("data"))),
        "warc-read",
    )
    cut = parts.filter("not simple").drop("simple", "n_read", "digest_read")
    streamed = cut.repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(running_digests, READ_SCHEMA)
    # The last row of a cut record holds all its bytes; the first one tells its type.
    at_end = F.max(F.struct("chunk", "n_read", "digest_read")).alias("end")
    columns = ["record", "type", "id", "n_bytes", "digest", "refers_to", "n_read", "digest_read"]
    others = (
        streamed.groupBy("record", "id", "n_bytes", "digest", "refers_to").agg(at_end, F.max("type").alias("type"))
        .select("record", "type", "id", "n_bytes", "digest", "refers_to", "end.n_read", "end.digest_read")
    )
    records = parts.filter("simple").select(columns).unionByName(others)
    same = (F.col("type") == "revisit") | (
        (F.col("n_read") == F.col("n_bytes")) & (F.col("digest_read") == F.col("digest"))
    )
    wrong = F.raise_error(F.concat(F.lit("damaged archive: the payload of record "), "record", F.lit(" is not what its header states")))
    checked = F.when(same, F.col("digest")).otherwise(wrong.cast("string"))
    return records.select("record", "type", "id", "n_bytes", checked.alias("digest"), "refers_to")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = write_archives(pages, stage_path(spark, "warc"), least=0)
    kind = pages.schema["page_id"].dataType
    return read_records(read_archives(spark, folder)).select(
        F.col("id").cast(kind).alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


OP12_SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), ranked AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS digest,
           row_number() OVER w AS place, first_value(page_id) OVER w AS best
    FROM payloads WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || digest[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT
               >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN best END AS refers_to
FROM ranked
"""
