"""A content-addressed WARC archive.

An archive is two tables in a folder: ``payloads`` holds each distinct payload once,
under its SHA-256, and ``headers`` holds, for each record, the exact bytes of its WARC
header and HTTP header, and the address of its payload. Original records come back by a
join of the two, with the digest of every payload checked again as it is read.

Among records with equal payloads that with the largest id is a response and the others
revisit it; equal ids are told apart by a row number that was written with the digests.
Payloads shorter than ``least`` bytes are all responses (and still stored once). Who is
a response is decided on digests alone; a payload that a third of all records share is
one row for each task before it is shuffled, and its records are never gathered.

A null payload is empty. A null id is the smallest, and its record's name ends in
``null``. Repeated rows are records of their own. Empty tables give empty archives;
other columns are ignored.

``records_of`` reads existing WARC files (plain or gzip), ``store`` keeps them in the
same layout with their headers as they were, and ``bodies`` gives every record back byte
for byte.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import counted, shared_folder, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"

# A response's block starts with this, before its payload.
HTTP = "HTTP/1.1 200 OK" + BREAK + "Content-Type: text/html; charset=utf-8" + BREAK + BREAK

# One date for all records of a run, so that running again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits, 20 bits at a time."""
    digest = F.sha1(payload)
    letters = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(ALPHABET), place, F.lit(1)))
    return F.concat(*letters)


def _name(id_: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """A WARC header: each pair a line, those with a null value left out, then an empty line."""
    given = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(BREAK))).otherwise("")
             for k, v in pairs]
    return F.concat(F.lit("WARC/1.1" + BREAK), *given, F.lit(BREAK))


def write_pages(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url",
                body: str = "html") -> None:
    """One record for each row, as an archive in ``folder``."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(f"`{body}`"), F.lit("")), "utf-8")
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    facts = written(
        rows.select("id", "url", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("sha1"),
                    F.octet_length("payload").cast("long").alias("bytes"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "warc-facts",
    )
    # Every response of a digest would be the same bytes, so the largest row stands for all.
    first = written(
        facts.groupBy("address").agg(F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "rid")).alias("first"))
        .select("address", F.col("first.id").alias("first_id"), F.col("first.rid").alias("first_rid")),
        "warc-first",
    )
    told = facts.join(first, "address").withColumn(
        "response", (F.col("bytes") < least) | (F.col("rid") == F.col("first_rid"))
    )
    revisit = ~F.col("response")
    blocks = F.when(F.col("response"), F.lit(len(HTTP)) + F.col("bytes")).otherwise(F.lit(len(HTTP)))
    header = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _name(F.col("id"))),
        ("WARC-Date", F.lit(DATE)),
        # A line break in an address would end its line.
        ("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", " ")),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, _name(F.col("first_id")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", blocks),
    )
    told.select(
        F.encode(header, "utf-8").alias("header"), F.encode(F.lit(HTTP), "utf-8").alias("http"),
        "address", F.col("response").alias("whole"),
    ).write.mode("overwrite").parquet(f"{folder}/headers")
    # The payload of a digest's first row; others have the same bytes and stay behind. Those
    # are named by address and id and taken out where the payloads are, so that only many
    # of them would move payloads.
    others = counted(
        told.where(~F.col("id").eqNullSafe(F.col("first_id"))).select(F.col("address").alias("a"), F.col("id").alias("i")).distinct(),
        "warc-others",
    )
    chosen = rows.select("payload", F.sha2("payload", 256).alias("address"), "id").join(
        others, (F.col("address") == F.col("a")) & F.col("id").eqNullSafe(F.col("i")), "left_anti"
    )
    repeated = not facts.groupBy("address", "id").count().where("count > 1").isEmpty()
    if repeated:  # equal ids with equal payloads: one row of each
        chosen = chosen.groupBy("address").agg(F.first("payload").alias("payload"))
    chosen.select("address", "payload").write.mode("overwrite").parquet(f"{folder}/payloads")


# --- reading --------------------------------------------------------------------------


def records(spark: SparkSession, folder: str) -> DataFrame:
    """header, http, whole, address, payload, and verified: its digest is its address."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    return (
        spark.read.parquet(f"{folder}/headers").join(payloads, "address", "left")
        .withColumn("verified", F.coalesce(F.sha2("payload", 256) == F.col("address"), F.lit(False)))
    )


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """``record``: the original bytes of every record, header to closing breaks."""
    nothing = F.lit(b"")
    return records(spark, folder).select(
        F.concat("header", F.coalesce("http", nothing), F.when(F.col("whole"), F.col("payload")).otherwise(nothing),
                 F.lit(b"\r\n\r\n")).alias("record"),
        "verified",
    )


def field(name: str, header: str = "_header") -> Column:
    """The value of a header line, null without one."""
    found = F.regexp_extract(header, rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def read_pages(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, from the archive.

    All of it is read from headers and payloads: ids and types from the header lines,
    sizes and digests from the stored bytes. A payload that does not have the digest its
    header states, or its address, fails the job.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    # What is asked of a payload is worked out where it is stored; only that meets the headers.
    facts = payloads.select(
        "address", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("address")).alias("_sound"),
    )
    rows = spark.read.parquet(f"{folder}/headers").select("address", F.decode("header", "utf-8").alias("_header"))
    rows = rows.join(facts, "address", "left")
    rows = rows.select(
        F.expr(f"try_cast(regexp_extract(_header, '(?m)^WARC-Record-ID: <urn:record:([^>]*)>', 1) as {kind})").alias("page_id"),
        "payload_bytes", "payload_digest",
        field("WARC-Type").alias("record_type"),
        F.expr(f"try_cast(regexp_extract(_header, '(?m)^WARC-Refers-To: <urn:record:([^>]*)>', 1) as {kind})").alias("refers_to"),
        field("WARC-Payload-Digest").alias("_stated"),
        F.coalesce("_sound", F.lit(False)).alias("verified"),
    )
    sound = F.col("verified") & (F.col("_stated") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    return rows.withColumn(
        "payload_digest",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest"))),
    ).drop("_stated", "verified")


def archive_pages(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url",
                  body: str = "html", folder: str | None = None) -> DataFrame:
    """Writes the archive of a page table and reads it back."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_pages(pages, folder, least, key, url, body)
    return read_pages(spark, folder, pages.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()).withColumnRenamed(
        "page_id", key
    )


# --- existing files -------------------------------------------------------------------


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of one file's bytes, by Content-Length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's header does not end")
        header = data[at : end + 4]
        size = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)\r$", header)
        if size is None:
            raise ValueError("a record without Content-Length")
        start = end + 4
        stop = start + int(size[1])
        yield header, data[start:stop]
        at = stop + 4


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """header, http and payload of the records of WARC files, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for header, block in split_records(content.as_py()):
                    # An HTTP message's own header belongs with the record's.
                    cut = block.find(b"\r\n\r\n") + 4 if b"application/http" in header.lower() else 0
                    cut = cut if cut >= 4 else 0
                    rows.append((header, block[:cut], block[cut:]))
                for at in range(0, len(rows), 200):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.binary()) for c in zip(*rows[at : at + 200])], names=["header", "http", "payload"]
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "header binary, http binary, payload binary"
    )


def store(found: DataFrame, folder: str) -> None:
    """Keeps records of ``records_of`` with their headers as they are, payloads once."""
    addressed = found.withColumn("address", F.sha2("payload", 256))
    addressed.select("header", "http", "address", F.lit(True).alias("whole")).write.mode("overwrite").parquet(
        f"{folder}/headers")
    addressed.groupBy("address").agg(F.first("payload").alias("payload")).write.mode("overwrite").parquet(
        f"{folder}/payloads")

