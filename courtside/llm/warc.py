"""WARC archives with revisit records.

``resolve`` shuffles only headers: a SHA-1 of each payload, and for each payload the largest id with it. ``write_warc``
writes WARC/1.1 files through Spark's text sink, so that task commits, retries and file systems are Spark's: a row is a
whole record, and the sink's line separator is the empty line pair that ends a record. ``read_warc`` reads any WARC
file, record by record by its Content-Length, and checks payload digests. ``resolve_revisits`` joins the revisit records
read to the responses they refer to.

An archive holds about ``file_bytes`` of payloads: a task with more deals its records to several archives by a hash of
their ids, so that a reader of one, which holds it whole, needs that much and the largest record.

Defined results: a null payload is empty. Records are equal if their payloads are, from ``min_bytes`` on; then the one
with the largest id is the response and the others revisit it. Rows that repeat that id and payload are responses all.
A null id is the least of all. Empty tables write no archives. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.shared import materialize

#: The digits of Spark's base 32 and those of RFC 4648.
_DIGITS, _RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "file string, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to_id string, digest_ok boolean, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four groups of 40 bits, each ten digits of base 16 and eight of base 32."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _DIGITS, _RFC4648)


def resolve(records: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """payload_digest, keep_id: for each payload that more than one record has, the id of its response."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    heads = records.select(F.col(id_col).alias("id"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("n"))
    return (
        heads.where(F.col("n") >= min_bytes)
        .groupBy("payload_digest")  # combined in each task first, so a payload that a third of all rows have is one row of each
        .agg(F.count("*").alias("copies"), F.max("id").alias("keep_id"))
        .where("copies > 1")
        .select("payload_digest", "keep_id")
    )


def record_urn(id_: Column) -> Column:
    """The record id of a row's id, percent-encoded, so that unlike ids have unlike records; ``id_of`` is its inverse."""
    return F.coalesce(F.concat(F.lit("<urn:x-record:"), F.url_encode(id_.cast("string")), F.lit(">")), F.lit("<urn:x-no-id>"))


def id_of(urn: Column) -> Column:
    """The id as text; null for the record of a null id, and for what is no record id."""
    found = r"^<urn:x-record:([^>]*)>$"
    return F.when(urn.rlike(found), F.url_decode(F.regexp_extract(urn, found, 1)))


def _archives(rows: DataFrame, file_bytes: int) -> int:
    """How many archives a task writes, by the payload bytes of the task that has most of them."""
    tasks = rows.select(F.spark_partition_id().alias("task"), F.octet_length("payload").alias("n")).groupBy("task").agg(F.sum("n").alias("n"))
    return max(1, -(-(tasks.agg(F.max("n")).first()[0] or 0) // file_bytes))


def write_warc(records: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0, file_bytes: int = 64_000_000, broadcast_rows: int = 200_000) -> None:
    """Write one record for each row: a response with an HTTP head and the payload, or a revisit without a body.

    Up to ``broadcast_rows`` repeated digests (of about 100 bytes each) go to the tasks, and no payload is shuffled;
    beyond, payloads are joined by digest. Records are dated by the time of writing.
    """
    one_line = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    rows = records.select(F.col(id_col).alias("id"), one_line(F.col(url_col)).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    repeated = materialize(resolve(records, id_col, payload_col, min_bytes), "repeated-payloads")
    found = rows.join(F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated, "payload_digest", "left")
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("keep_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(_CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_CRLF}WARC-Record-ID: "),
        record_urn(F.col("id")),
        F.lit(f"{_CRLF}WARC-Date: "),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{_CRLF}WARC-Target-URI: "),
        F.col("url"),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: "), record_urn(F.col("keep_id")))).otherwise(F.lit("")),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "),
    )
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    value = F.concat(head, F.octet_length(block).cast("string"), F.lit(_CRLF * 2), block).alias("value")
    archives = _archives(found, file_bytes)
    if archives == 1:
        found.select(value).write.option("lineSep", _CRLF * 2).text(path)
    else:  # a task writes its archives one after the other, sorted by their number
        dealt = found.select(value, F.pmod(F.xxhash64("id", "url"), F.lit(archives)).cast("int").alias("archive"))
        dealt.write.option("lineSep", _CRLF * 2).partitionBy("archive").text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, gzip or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            break
        lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = head_end + 4, int(headers.get("content-length", 0))
        yield headers, view[start : start + n]
        at = start + n + 4


def _parse(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows, held = [], 0
            for h, block in _records(content.as_py()):
                payload = bytes(block)
                if "application/http" in h.get("content-type", ""):
                    payload = payload[payload.find(b"\r\n\r\n") + 4 :] if payload else b""
                digest = re.sub("^sha1:", "", h.get("warc-payload-digest", "")) or None
                whole = h.get("warc-type") != "revisit"
                fits = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest if whole and digest else None
                rows.append((name, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), digest, len(payload) if whole else None, h.get("warc-refers-to"), fits, payload if with_payload and whole else None))
                held += len(payload) if with_payload else 0
                if len(rows) >= 4096 or held > 16_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of every file in ``path``, as READ_SCHEMA says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").load(path).select("path", "content")
    return files.mapInArrow(lambda b: _parse(b, with_payload), READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The records with, for revisits, the length of the payload of the response that they refer to; null where none has their digest."""
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"), "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    revisits = records.where("record_type = 'revisit'").join(responses, ["refers_to_id", "payload_digest"], "left")
    plain = records.where("record_type <> 'revisit'")
    return plain.unionByName(revisits.withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes"))
