"""WARC archives without repeated payloads.

Headers are shuffled by payload digest; of equal payloads the record with the largest id stays a response and
the others become revisit records that refer to it, with fresh headers. Archives are written by Spark's text
sink, whose line separator is the blank lines that end a WARC record: any file system Spark can reach will do,
and a lost task is simply written again by the commit protocol. Records of different size go to archives of different
lengths, so that no archive is longer than FILE_BYTES or than one record. Reading parses records by Content-Length, and
joins revisits to their responses by record id, which is made from a page's id and its payload's digest.

Defined results: a null payload is empty; a null page_id is never chosen over another, and such rows stay
responses if all of a digest are so; repeated rows of the chosen page are all responses; a page_id with several payloads
is one record for each, with its own id; null and odd urls are written percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Bounds what one read task holds: a file is read whole.
FILE_BYTES = 1 << 26
#: Size classes of payloads by their upper bounds in bytes; an archive of a class holds as many as fit FILE_BYTES.
SIZE_CLASSES = (1 << 16, 1 << 20, 1 << 23)


def sha1_base32(binary: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(binary), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, record_type and refers_to. Only the largest id of each
    digest is shuffled besides the records, summed in the map tasks; the join's record side can be split, so
    a digest shared by a third of all pages doesn't wait on one task."""
    payload = F.coalesce("html", F.lit(""))
    records = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "digest": sha1_base32(F.col("payload").cast("binary"))}
    )
    headers = pages.select("page_id", payload.alias("payload")).filter(F.octet_length("payload") >= min_bytes)
    chosen = headers.groupBy(sha1_base32(F.col("payload").cast("binary")).alias("digest")).agg(F.max("page_id").alias("original"))
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return records.join(chosen, "digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def record_id(page_id: Column, digest: Column) -> Column:
    """A urn:uuid made from the page's id and its payload's digest."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", F.concat(F.lit("urn:uuid:"), cut(1, 8)), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def percent_encoded(url: Column) -> Column:
    """A url whose blanks and control characters are written as their codes; most urls have none and stay as they are."""
    odd, each = r"[\x00-\x20\x7F]", F.split(url, "")
    code = lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c).cast("long")), 2, "0"))
    return F.when(url.rlike(odd), F.array_join(F.transform(each, lambda c: F.when(c.rlike(odd), code(c)).otherwise(c)), "")).otherwise(url)


def to_record(date: str) -> Column:
    """One WARC record over the columns of resolve(), without its end."""
    uri = percent_encoded(F.coalesce("url", F.lit("")))
    revisit = F.col("record_type") == "revisit"
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("digest")), F.lit(">"))),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, block)


def _size_class(size: Column) -> Column:
    return sum(((size > bound).cast("int") for bound in SIZE_CLASSES), F.lit(0))


def size_classes(pages: DataFrame) -> list[int]:
    """The size classes that the payloads of pages fall into; a few integers."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return sorted(r[0] for r in pages.select(_size_class(size).alias("k")).distinct().collect()) or [0]


def write(records: DataFrame, path: str, classes: list[int], date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the records of resolve() as gzipped archives, each size class that occurs in a folder of its own."""
    for k in classes:
        own = records.filter(_size_class(F.col("payload_bytes")) == k)
        out = own.select(to_record(date).alias("value")).write.option("lineSep", END).option("compression", "gzip")
        fit = FILE_BYTES // SIZE_CLASSES[k] if k < len(SIZE_CLASSES) else 1
        out.option("maxRecordsPerFile", fit).text(f"{path}/class={k}")


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes pages without repeated payloads."""
    write(resolve(pages, min_bytes), path, size_classes(pages))


READ = "page_id long, record_type string, record_id string, refers_to_id string, header_digest string, declared_bytes long, payload_bytes long, payload_digest string"


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of READ for the records of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = next(int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
        full = head["WARC-Type"] == "response"
        yield (
            int(head["X-Page-ID"]) if "X-Page-ID" in head else None, head["WARC-Type"], head["WARC-Record-ID"].strip("<>"),
            head.get("WARC-Refers-To", "").strip("<>") or None, head["WARC-Payload-Digest"].removeprefix("sha1:"), declared,
            len(payload) if full else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else None,
        )


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
             ("header_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    for batch in batches:
        for content in batch.column("content"):
            rows = list(parse(zlib.decompress(content.as_py(), 47)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives, one row each, with size and digest as found in responses."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    return files.load(path).select("content").mapInArrow(_parse_files, READ)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """Archived pages with their whole payload's size and digest; a revisit has those of its response."""
    rows = read(spark, path)
    responses = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("response_id")).agg(
        # repeated rows write one record several times
        F.max("page_id").alias("original"), F.max("payload_bytes").alias("original_bytes"), F.max("payload_digest").alias("original_digest")
    )
    # a response meets itself, so that no null key gathers them in one task
    meets = F.coalesce("refers_to_id", "record_id") == F.col("response_id")
    return rows.join(responses, meets, "left").select(
        "page_id",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "original_digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("original")).alias("refers_to"),
        "header_digest",
    )
