"""WARC archives and revisit resolution.

``write_archives`` writes one record per row with Spark's text writer: a record
ends with two CRLFs, which is the writer's line separator, so executors write
the shared folder through Spark's committer, gzip-compressed, at most
``RECORDS`` records to a file. ``read_archives`` streams the files through Spark's text
reader with the same separator and joins the pieces by Content-Length, so payloads may hold
anything and a worker holds some records, never a file.

``resolve`` shuffles headers only: records are grouped by payload digest with
a partial minimum, and every record of at least ``LEAST`` payload bytes refers to
the smallest of its digest. ``deduplicate`` joins that to the records and
writes fresh headers: the original becomes a response, the others revisit
records without payload. Reading back, revisits are joined to their originals
for the payload's length.

Defined results: a NULL payload is empty; payloads below ``LEAST`` bytes are always
responses; of records with equal payload and equal page_id (repeated rows) the
first by record id is the original and the others revisit it; a NULL page_id
sorts last and is written as an empty header; a NULL url likewise; line breaks
in a url are written as spaces; an empty table writes no records and gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import new_folder, staged, utf8_values

LEAST = 100
#: Most records in one archive file.
RECORDS = 1000
#: Payload bytes that a reading task hands on at once.
HELD = 1 << 24
END = "\r\n\r\n"
MARK = END.encode()
#: Fixed value: the date of every record (payloads carry none).
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"\r\n{name}: "), F.coalesce(value.cast("string"), F.lit("")))


def record_text(rows: DataFrame) -> DataFrame:
    """record_id, page_id, url, payload, payload_digest, refers_to, refers_to_id to the record's text."""
    revisit = F.col("refers_to_id").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit("")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(REVISIT)), _line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), "refers_to_id", F.lit(">"))))).otherwise(F.lit("")),
        _line("X-Page-Id", F.col("page_id")), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body)),
    )
    return rows.select(F.concat(head, F.lit(END), body).alias("value"))


def write_archives(rows: DataFrame, path: str) -> None:
    (record_text(rows).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS).text(path))


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record, from an archive's pieces between its ``END`` marks.

    A head is one piece. A payload may hold marks itself, so pieces are joined
    until its Content-Length is reached; one that ends with a line break moves the
    mark after it, and the next head then follows some line breaks.
    """
    headers: dict[str, str] | None = None
    body, have, size = [], 0, 0
    for piece in pieces:
        if headers is None:
            head = piece.lstrip(b"\r\n")
            if not head:
                continue
            if not head.startswith(b"WARC/1."):
                raise ValueError(f"no record at {head[:40]!r}")
            lines = head.decode().split("\r\n")[1:]
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
            body, have, size = [], 0, int(headers["Content-Length"])
        else:
            body += [piece, MARK]
            have += len(piece) + len(MARK)
        if have >= size:
            yield headers, b"".join(body)[:size]
            headers = None
    if headers is not None:
        raise ValueError(f"the archive ends within record {headers.get('WARC-Record-ID')}")


RECORD = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, payload_bytes long"


def _clean(value: str | None) -> str | None:
    return re.sub(r"^<urn:record:|>$|^sha256:", "", value) if value else None


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record: the headers, the payload's stored length and, if asked for, the payload."""
    schema = RECORD + (", payload string" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pieces = (v.tobytes() for batch in batches for v in utf8_values(batch.column("value")))
        for h, body in parse(pieces):
            row = (
                _clean(h["WARC-Record-ID"]), h["WARC-Type"], int(h["X-Page-Id"]) if h.get("X-Page-Id") else None,
                h.get("WARC-Target-URI") or None, _clean(h["WARC-Payload-Digest"]), _clean(h.get("WARC-Refers-To")), len(body),
            )
            rows.append((*row, body.decode()) if payload else row)
            held += len(body) if payload else 0
            if len(rows) >= RECORDS or held >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # gzip files are never split, so a task reads its archives' pieces from their first to their last.
    files = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").schema("value string").text(path)
    return files.mapInArrow(run, schema)


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """record_id, refers_to, refers_to_id for the records that repeat an earlier payload."""
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    long = headers.where(F.col("payload_bytes") >= least)
    first = long.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = long.join(first, "payload_digest").where(F.col("record_id") != F.col("first.record_id"))
    return again.select("record_id", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_id"))


def deduplicate(spark: SparkSession, source: str, target: str, least: int = LEAST) -> None:
    """Read the archives at ``source``; write them to ``target`` with repeated payloads as revisit records."""
    links = staged(resolve(read_archives(spark, source), least), "warc_links")
    records = read_archives(spark, source, payload=True).select("record_id", "page_id", "url", "payload_digest", "payload")
    write_archives(records.join(links, "record_id", "left"), target)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; revisits joined to their originals."""
    records = staged(read_archives(spark, path), "warc_records")
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole")
    )
    responses = records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url"
    )
    # An original with many revisits meets them in a join on its unique id, whose revisit side AQE can split.
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to_id").select(
        "page_id", F.col("whole").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url"
    )
    return responses.union(revisits)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write a record per page, resolve revisits, write the deduplicated archives and read them back."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    place = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.spark_partition_id(), F.monotonically_increasing_id())
    rows = pages.select(
        place.alias("record_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"),
        digest.alias("payload_digest"), F.lit(None).cast("string").alias("refers_to_id"),
    )
    raw, final = new_folder(spark, "warc_raw"), new_folder(spark, "warc_final")
    write_archives(rows, raw)
    deduplicate(spark, raw, final)
    return read_resolved(spark, final)
