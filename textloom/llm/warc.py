"""WARC archives in which equal payloads are stored once.

Each page is one record. Headers (digest, id, address) are shuffled by payload
digest to find, for each digest with several payloads of at least ``least_bytes``
bytes, the one with the smallest page id; the payloads stay where they are. Rows
then join their digest's original: the original and all single rows become
``response`` records, the others ``revisit`` records with fresh headers that
refer to it, with its date and address, and carry no payload.

The digest table is written first, so the join is planned by its true size:
broadcast if small, else sorted and merged, where skewed digests are split. The
archives are Spark text output (WARC's record separator as line separator), so
any store works and a lost task is committed once. Records are written in pieces
of ``PIECE_BYTES``, so a file holds at most ``pieces_per_file`` of those and as
many longest records; it is read back by one task.

Record ids come from page id, digest and the row's number in ``pages``, so they
are unique; ``pages`` is read twice and must come in the same partitions both
times, as files do.

Defined results: null html is an empty payload (always a response); a null url
leaves the target header out; a null page id leaves its header out, orders after
all ids and reads back as null (if no row of the digest has an id, all are
responses). Rows that repeat the smallest id of their digest are all responses.
An empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import materialize
from textloom.sources.scratch import shared_path

LEAST_BYTES, PIECE_BYTES, PIECES_PER_FILE = 100, 16 << 20, 16
SEPARATOR = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(row: Column, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", row.cast("string"), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """row, page_id, url, payload, bytes, digest; and original_row, original_id, original_url of revisits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace("url", r"[\r\n]", " ").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    headers = rows.filter(F.col("bytes") >= least_bytes).select("digest", "page_id", "row", "url")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url")))
    shared = headers.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("original")).filter("n > 1 and original is not null")
    shared = shared.select(F.col("digest").alias("_digest"), *[F.col(f"original.{c}").alias(a) for c, a in (("row", "original_row"), ("page_id", "original_id"), ("url", "original_url"))])
    shared = materialize(shared, "warc-originals")
    joined = rows.join(shared, rows["digest"] == shared["_digest"], "left").drop("_digest")
    is_original = F.col("page_id").eqNullSafe(F.col("original_id"))
    return joined.withColumns({c: F.when(~is_original, F.col(c)) for c in ("original_row", "original_id", "original_url")})


def _lines(*lines: Column) -> Column:
    """Those that are not null, each ended by CRLF."""
    return F.concat(*[F.coalesce(F.concat(line, F.lit("\r\n")), F.lit("")) for line in lines])


def records(resolved: DataFrame, date: str | None = None) -> DataFrame:
    """One string a record, without the separator after it; ``date`` is the capture's, by default now."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("original_id").isNotNull()
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), header("Content-Length", F.col("bytes").cast("string")))
    block = F.concat(http, F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = _lines(
        F.lit("WARC/1.1"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_id(F.col("row"), F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Page-ID", F.col("page_id").cast("string")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, header("WARC-Refers-To", record_id(F.col("original_row"), F.col("original_id"), F.col("digest")))),
        F.when(revisit, header("WARC-Refers-To-Target-URI", F.col("original_url"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        header("Content-Length", F.octet_length("block").cast("string")),
    )
    return resolved.withColumn("block", block).select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def pieces(lines: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Runs of the records of ``lines``, with separators between, that end at ``piece_bytes`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, size = [], 0
            for value in batch.column(0).cast(pa.binary()):
                waiting.append(value.as_py())
                size += len(waiting[-1])
                if size >= piece_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(waiting)], pa.binary())], names=["value"])
                    waiting, size = [], 0
            if waiting:
                yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(waiting)], pa.binary())], names=["value"])

    return lines.mapInArrow(run, "value binary").select(F.col("value").cast("string"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, pieces_per_file: int = PIECES_PER_FILE, date: str | None = None) -> None:
    found = pieces(records(resolve(pages, least_bytes), date))
    found.write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", pieces_per_file).text(path)


def parse(content: bytes) -> Iterator[dict]:
    """The records of one archive: headers in lower case, and ``block``."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        start = end + 4
        fields["block"] = content[start : start + int(fields["content-length"])]
        yield fields
        at = start + len(fields["block"]) + 4


_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_record string"


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id of each record.

    Sizes and digests of responses are taken from the stored payload; those of
    revisits from their headers. ``refers_to`` is the page id of the response
    that a revisit's record id names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for r in parse(value.as_py()):
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    stated = r["warc-payload-digest"].removeprefix("sha256:")
                    page = int(r["warc-page-id"]) if "warc-page-id" in r else None
                    if r["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"page {page}: stored payload does not match its digest")
                    else:
                        size, digest = int(http.rpartition(b"Content-Length: ")[2]), stated
                    rows.append((page, size, digest, r["warc-type"], r["warc-record-id"], r.get("warc-refers-to")))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = materialize(files.mapInArrow(run, _SCHEMA), "warc-read")
    named = found.filter("record_type = 'revisit'").groupBy("refers_record").count().select(F.col("refers_record").alias("_named"))
    targets = found.filter("record_type = 'response'").join(named, F.col("record_id") == F.col("_named"), "left_semi")
    targets = targets.groupBy("record_id").agg(F.min("page_id").alias("refers_to")).withColumnRenamed("record_id", "_target")
    targets = materialize(targets, "warc-targets")
    joined = found.join(targets, found["refers_record"] == targets["_target"], "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path).drop("record_id")


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
m AS (SELECT *, count(*) OVER g AS n, min(page_id) OVER g AS first_id FROM d WINDOW g AS (PARTITION BY payload_digest)),
r AS (SELECT *, coalesce(payload_bytes >= {LEAST_BYTES} AND n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id, false) AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to FROM r
"""
