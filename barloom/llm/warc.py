"""Content-addressed web archive: payloads once by SHA-256, exact record headers apart, records rebuilt by joins.

An archive is a folder of two tables. ``payloads`` (digest, payload) has each distinct payload once.
``headers`` (page_id, digest, type, refers_to, header) has for each page the exact bytes of its WARC/1.1 record header. A record is
header + payload + CRLF CRLF; a revisit record has no payload of its own and stands for that of the record it refers to.

Of the pages with equal payloads of at least ``revisit_bytes`` bytes the one of the smallest page_id is the response and the others
revisit it; shorter payloads are always responses. A null html is an empty payload, a null url an empty URI. Pages with equal ids
are records of their own; if the smallest id occurs twice, all its rows are responses. Null ids count as the largest.
Reading checks each payload against its digest and fails on a damaged one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.cluster import shared_folder

REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def record_id(page_id: Column, url: Column) -> Column:
    """A stable record id from the page's id and URL."""
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), url))
    return F.concat(F.lit("<urn:uuid:"), *[
        x for k, (s, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        for x in ([F.lit("-")] if k else []) + [F.substring(h, s, n)]], F.lit(">"))


def _header(kind: Column, fields: list[tuple[str, Column]]) -> Column:
    """Header lines; a field of null value has no line."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"), *[
        F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields],
        F.lit("\r\n"))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> str:
    """Write the two tables below ``folder`` and return it.

    Copies of a payload meet in partial aggregates before the exchange, so a payload that a third of the pages
    share travels once a task. Headers are joined with one slim row a digest; their payloads stay where they are.
    """
    given = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    keyed = given.withColumn("digest", F.sha2("payload", 256))
    keyed.groupBy("digest").agg(F.first("payload").alias("payload")) \
        .write.option("compression", "zstd").parquet(f"{folder}/payloads")

    slim = keyed.withColumn("size", F.octet_length("payload")).drop("payload")
    first = slim.where(F.col("size") >= revisit_bytes).groupBy("digest") \
        .agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    linked = slim.join(first, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    kind = F.when(again, "revisit").otherwise("response")
    only_again = lambda c: F.when(again, c)
    header = _header(kind, [
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"))),
        ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Refers-To", only_again(record_id(F.col("first_id"), F.col("first_url")))),
        ("WARC-Refers-To-Target-URI", only_again(F.col("first_url"))), ("WARC-Profile", only_again(F.lit(PROFILE))),
        ("Content-Type", F.lit("text/html")), ("Content-Length", F.when(again, 0).otherwise(F.col("size")))])
    linked.select("page_id", "digest", kind.alias("type"), only_again(F.col("first_id")).alias("refers_to"),
                  header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")
    return folder


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) after each payload has been hashed again."""
    table = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    true = F.sha2("payload", 256)
    return table.withColumn("digest", F.when(true == F.col("digest"), true).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("string")))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: page_id, type, digest, refers_to, payload (of what it refers to, for a revisit) and record,
    the bytes of the original record."""
    headers = spark.read.schema("page_id long, digest string, type string, refers_to long, header binary") \
        .parquet(f"{folder}/headers")
    own = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(read_payloads(spark, folder), "digest").select(
        "page_id", "type", "digest", "refers_to", "payload", F.concat("header", own, F.lit(END.encode())).alias("record"))


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """``pages`` written to a new archive in the shared folder, then its records."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, shared_folder(spark, "archive"), **columns))
