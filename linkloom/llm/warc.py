"""Content-addressed WARC archive.

A record's payload is stored once, under the SHA-256 of its bytes, in ``payloads``; the exact bytes of
each record's header stand in ``headers`` with that digest. Reading verifies every stored payload against
its digest, and a join of the two tables gives back the original records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_root, stash

REVISIT_BYTES = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _header(row_type: Column, page: Column, url: Column, sha1: Column, size: Column, refers_to: Column, date: str) -> Column:
    """The WARC header as it stands before the payload, with the empty line that ends it."""
    revisit = row_type == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), row_type),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(refers_to))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, revisit_bytes: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write one record per row of ``pages`` under ``path`` (by default in the shared folder); its place is returned.

    Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the largest id is the
    response and the others revisit it; rows that repeat that id and payload are responses too. Smaller
    payloads are responses all. A null payload counts as empty; a null id comes before all others.
    """
    spark = pages.sparkSession
    path = path or f"{shared_root(spark)}/linkloom/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    pages = pick(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    rows = pages.select("page_id", "url", payload)
    digests = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    # one row for each content and map task goes through the shuffle, however often the content occurs
    # and is written, so that the join has no aggregate in its stage and Spark can split a frequent digest
    first = stash(digests.groupBy("digest").agg(F.max("page_id").alias("holder")), "holders")
    joined = digests.join(first, "digest")
    revisit = (F.col("size") >= revisit_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = _header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), F.col("size"), F.col("holder"), date)
    joined.select(F.col("page_id").alias("record"), "digest", header.alias("header")).write.parquet(f"{path}/headers")
    rows.withColumn("digest", F.sha2("payload", 256)).dropDuplicates(["digest"]).select("digest", "payload").write.parquet(f"{path}/payloads")
    return path


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, payload_bytes, sha1 of every stored payload; a payload that doesn't match its digest raises an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    whole = F.assert_true(F.sha2("payload", 256) == F.col("digest"), F.lit("a stored payload does not match its digest"))
    stored = stored.select(F.coalesce(whole.cast("string"), F.col("digest")).alias("digest"), "payload")
    return stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """digest, header and what the header says: record, record_type, stated (the payload's SHA-1), refers_to."""
    kept = spark.read.schema("record long, digest string, header binary").parquet(f"{path}/headers")
    page = lambda name: F.regexp_extract(_field(F.col("header"), name), "^<urn:page:(.*)>$", 1)
    number = lambda name: F.when(page(name) != "", page(name)).cast("long")
    return kept.select("digest", "header", number("WARC-Record-ID").alias("record"), _field(F.col("header"), "WARC-Type").alias("record_type"), F.regexp_extract(_field(F.col("header"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated"), number("WARC-Refers-To").alias("refers_to"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Headers joined with their verified payloads: one row per record. A join is skewed by a frequent payload, which Spark splits."""
    return read_headers(spark, path).join(read_payloads(spark, path), "digest")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """record, bytes: each WARC record byte for byte; a revisit's block is empty."""
    end = F.lit(CRLF + CRLF).cast("binary")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return read_records(spark, path).select("record", F.concat("header", block, end).alias("bytes"))
