"""WARC archives with resolved revisits.

Headers are shuffled by payload digest; of equal payloads of at least
``least_bytes`` the row with the smallest page_id is the response and the others
become revisit records that refer to it. Archives are written by Spark's text
writer, whose record separator is the two line ends that close a WARC record, so
a lost task is written again and a failed one leaves no part of a file.

Cases: a null html is the empty payload; a null page_id sorts last and has an
empty page header; rows that repeat the smallest page_id are all responses; line
ends in a url are written percent-encoded; an empty table gives no record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 16 << 20


def headers(pages: DataFrame, *more: Column) -> DataFrame:
    """page_id, url, digest and n of each page, and no payload unless it is asked for."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"), *more)


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, digest, n and refers_to of the pages that revisit another.

    Only headers are shuffled. The first pages are written before they are joined,
    so the headers of a common payload are split among tasks.
    """
    heads = headers(pages).where(F.col("n") >= least_bytes)
    firsts = stored(heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("m")).where("m > 1").select("digest", "refers_to"), "firsts")
    return heads.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "url", "digest", "n", "refers_to")


def resolved(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, n, refers_to (null for responses).

    Payloads are kept where no revisit has their page and digest, so they move by
    page, never by digest, and only if the revisits are too many to be broadcast.
    """
    again = stored(revisits(pages, least_bytes), "revisits")
    gone = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct()
    own = headers(pages, F.coalesce("html", F.lit("")).alias("payload"))
    responses = own.join(gone, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left_anti")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again.withColumn("payload", F.lit(None).cast("string")))


def _id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def record(row: DataFrame) -> Column:
    """The record of a resolved row, without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _id(F.col("refers_to"), F.col("digest"))), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write(pages: DataFrame, path: str, *, least_bytes: int = 100, file_bytes: int = FILE_BYTES) -> None:
    """Write gzip-compressed archives of about ``file_bytes`` uncompressed bytes.

    A file is one gzip stream.
    """
    sizes = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600).alias("b"), F.count("*").alias("n")).first()
    records = max(1, file_bytes * sizes["n"] // max(1, sizes["b"] or 0))
    rows = resolved(pages, least_bytes)
    rows.select(record(rows).alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        yield headers, stream.read(int(headers["Content-Length"]))


def read(spark, path: str) -> DataFrame:
    """The records of archives: page_id, url, record_type, digest, refers_to, payload.

    A file is one task's work; its size is the writer's ``file_bytes``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "record_type", "digest", "refers_to", "payload")
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                    payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(refers) if refers else None, payload))
                    if len(rows) >= 256:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(records, "page_id long, url string, record_type string, digest string, refers_to long, payload binary")


def digested(records: DataFrame) -> DataFrame:
    """Each record's full payload as length and digest; revisits take the response's."""
    own = records.select("page_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("sha"))
    kept = own.where("record_type = 'response'").groupBy("digest", F.col("page_id").alias("refers_to")).agg(F.first("n").alias("rn"), F.first("sha").alias("rsha"))
    responses = own.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to")
    revisits = own.where("record_type = 'revisit'").join(kept, ["digest", "refers_to"], "left").select("page_id", F.col("rn").alias("payload_bytes"), F.col("rsha").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits)


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives in ``path`` (by default in the shared folder) and read them."""
    path = path or f"{shared_dir(pages.sparkSession)}-warc"
    write(pages, path, **options)
    return digested(read(pages.sparkSession, path))
