"""WARC archives: writing pages, reading them back, and transaction assembly.

Each page becomes a request, a response (or revisit) and a metadata record; the first and the last
name the second in WARC-Concurrent-To. Spark's text writer writes the records, with the blank line
that ends a WARC record as its line separator, so any file system that Spark knows will do. Reading
goes by Content-Length, and assembly brings the three kinds of records together by the capture they name, into one nested row.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.common import shared_dir

EOL = "\r\n"
#: From so many bytes on, equal payloads are stored once.
REVISIT_BYTES = 1000
#: Records in an archive at most: those of 1,000 pages. So it is longer than 2 GB only if its pages have 2 MB each on average, compressed.
FILE_RECORDS = 3000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:lettermill:"


def record(kind: str, headers: list[tuple[str, Column]], content_type: str, content: Column) -> Column:
    """A WARC record without the blank line that ends it; headers with a null value are left out."""
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Date: {DATE}{EOL}")]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(EOL)), F.lit("")) for k, v in headers]
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}{EOL}Content-Length: "), F.octet_length(content).cast("string"), F.lit(EOL * 2), content)


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives of pages (page_id, url, html) in a new folder.

    Of pages with equal payloads of at least revisit_bytes bytes the one with the largest page_id (of
    repeated rows one) is a response, the others are revisits of it. A null html is an empty payload,
    a null url leaves its header out, a null page_id comes before all others.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("nr")
    )
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    large = rows.filter(F.col("size") >= revisit_bytes).select("digest", F.struct("page_id", "nr").alias("at"))
    owners = large.groupBy("digest").agg(F.max("at").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "owner")
    named = lambda kind, at: F.concat(F.lit(f"<{URN}{kind}:"), F.coalesce(at["page_id"].cast("string"), F.lit("")), F.lit(":"), at["nr"].cast("string"), F.lit(">"))
    own = F.struct("page_id", "nr")
    key = F.when(F.col("size") >= revisit_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("nr").cast("string")))  # small payloads meet nothing, and so don't meet in one task
    all_rows = rows.withColumn("key", key).join(owners.withColumnRenamed("digest", "key"), "key", "left").drop("key")
    first = F.col("owner").isNull() | (F.col("owner") == own)
    capture, uri = named("response", own), ("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL * 2))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{EOL * 2}"))
    records = F.array(
        record("request", [("WARC-Record-ID", named("request", own)), ("WARC-Concurrent-To", capture), uri], "application/http; msgtype=request", get),
        F.when(first, record("response", [("WARC-Record-ID", capture), uri, digest], "application/http; msgtype=response", F.concat(http, "payload"))).otherwise(
            record("revisit", [("WARC-Record-ID", capture), uri, digest, ("WARC-Refers-To", named("response", F.col("owner"))), ("WARC-Profile", F.lit(PROFILE))], "application/http; msgtype=response", http)
        ),
        record("metadata", [("WARC-Record-ID", named("metadata", own)), ("WARC-Concurrent-To", capture), uri], "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL))),
    )
    all_rows.select(F.explode(records).alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of every record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


FIELDS = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, content_type string, payload_digest string, payload_bytes long, content binary"


def read_warc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """The request, response, revisit and metadata records in the archives of a folder.

    For responses the payload's digest (SHA-1, lower-case hex) and length are computed from the
    payload and a digest that differs from its header's is an error; revisits have them from their
    headers. content: the payload of responses, the block of other records; without content it is
    null for responses and revisits. A task reads an archive at a time, which can be up to 2 GB (as Spark's binary files); write_warc() bounds its own (see FILE_RECORDS).
    """

    def payload(block: bytes) -> tuple[int, bytes]:
        head, _, body = block.partition(b"\r\n\r\n")
        said = [int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return said[0] if said else len(body), body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for batch in batches:
            for raw in batch.column("content"):
                whole, rows, size = io.BytesIO(raw.as_buffer()), [], 0
                stream = gzip.GzipFile(fileobj=whole) if whole.read(2) == b"\x1f\x8b" else whole
                whole.seek(0)
                for h, block in parsed(io.BufferedReader(stream)):
                    kind = h.get("warc-type")
                    if kind not in ("request", "response", "revisit", "metadata"):
                        continue
                    digest, n, body = h.get("warc-payload-digest", "").rpartition(":")[2].lower() or None, None, block
                    if kind in ("response", "revisit"):
                        n, body = payload(block)
                    if kind == "response":
                        n, said, digest = len(body), digest, hashlib.sha1(body).hexdigest()
                        if said not in (None, digest):
                            raise ValueError(f"the payload of {h.get('warc-record-id')} doesn't have its digest")
                    if kind in ("response", "revisit") and not content:
                        body = None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("content-type"), digest, n, body))
                    size += 200 + len(body or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, FIELDS)


def transactions(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """One nested row for each capture: response (or revisit), with its request and metadata (null without one).

    A request or metadata record belongs to the capture that its concurrent-to names; of several of a
    kind that with the least id stays, and those without a capture go. All records are read once and meet in one
    shuffle.
    """
    records = read_warc(spark, path, content)
    capture = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    least = lambda of, *columns: F.min(F.when(of, F.struct("record_id", *columns)))
    side = ("target_uri", "content_type", F.col("content").cast("string").alias("content"))
    rows = records.groupBy(capture.alias("capture_id")).agg(
        least(F.col("type") == "request", *side).alias("request"),
        least(F.col("type").isin("response", "revisit"), *[c for c in records.columns if c not in ("record_id", "concurrent_to")]).alias("response"),
        least(F.col("type") == "metadata", *side).alias("metadata"),
    )
    return rows.filter("response IS NOT NULL")


def round_trip(pages: DataFrame, content: bool = False) -> DataFrame:
    """Pages written to archives in the shared folder, read back and assembled: a row for each page with
    page_id, payload_bytes, payload_digest, record_type and refers_to, and the nested records.

    refers_to is the page_id of the response that a revisit stands for, else null. An empty table
    gives no rows; see write_warc() for nulls and repeated rows. Only page_id, url and html are read.
    """
    path = shared_dir(pages.sparkSession)
    write_warc(pages, path)
    rows = transactions(pages.sparkSession, path, content)
    number = lambda x: F.expr(f"try_cast(regexp_extract({x}, ':(-?[0-9]*):[0-9]+>$', 1) AS BIGINT)")
    return rows.select(
        F.expr("try_cast(regexp_extract(metadata.content, 'pageId: (-?[0-9]*)', 1) AS BIGINT)").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number("response.refers_to").alias("refers_to"),
        "request",
        "response",
        "metadata",
    )
