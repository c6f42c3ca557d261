"""Content-addressed web archive: payload bytes once by digest, record headers apart, records rebuilt by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.llm.text import small_or_shuffled

BASE32_OF_CONV = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")  # fixed values: RFC 4648
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: 40 hex digits are eight groups of five, each four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *BASE32_OF_CONV)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def _record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0
) -> None:
    """Write ``path/payloads`` (SHA-256 digest, bytes, once each) and ``path/headers`` (one row per page).

    Of the records with equal payloads of at least ``least`` bytes the one with the largest page id is the response
    and the others are revisits that refer to it; a shorter payload is a response everywhere. Rows that repeat the
    largest id with the same payload are all responses. A null id comes last. A null html is an empty payload; a null
    url gives an empty target. The digest is verified while equal ones are brought together: if two payloads of one
    digest differ in length or SHA-1, the write fails.

    Which row carries the payload of a digest is found on narrow rows: the response. The task that reads a page writes
    its payload, so no payload is shuffled. It looks up only digests that occur more than once; where those are too
    many to be sent to every task, the rows are dealt by digest instead. If several rows are the response of a digest,
    its payload is picked from them.
    """
    content = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    described = content.select(
        "page_id", "url", "digest", F.length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")
    )
    chosen = described.groupBy("digest").agg(
        F.max("page_id").alias("response_id"),
        F.count(F.lit(1)).alias("rows"),
        ((F.min("bytes") == F.max("bytes")) & (F.min("sha1") == F.max("sha1"))).alias("same"),
    )
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_uri(F.col("page_id"))),
        F.when(revisit, _line("WARC-Refers-To", _record_uri(F.col("response_id")))).otherwise(""),
        _line("WARC-Target-URI", target),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(EOL),
    )
    checked = F.when(F.col("same"), header).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    described.join(chosen, "digest").select("digest", checked.alias("header")).write.parquet(f"{path}/headers")
    answering = F.col("page_id").eqNullSafe(F.col("response_id"))
    repeated = described.join(chosen.where("rows > 1").select("digest", "response_id"), "digest").where(answering)
    carriers = repeated.groupBy("digest").agg(F.max("response_id").alias("response_id"), (F.count(F.lit(1)) > 1).alias("several"))
    carriers = small_or_shuffled(carriers, "archive-carriers")
    told = content.select("digest", "page_id", "payload").join(carriers, "digest", "left")
    carried = told.where(F.col("several").isNull() | (~F.col("several") & answering)).select("digest", "payload")
    carried.write.parquet(f"{path}/payloads")
    if not carriers.where("several").isEmpty():
        picked = told.where(F.col("several") & answering).groupBy("digest").agg(F.first("payload").alias("payload"))
        picked.write.mode("append").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``header, payload`` of every record, rebuilt by joining the headers with the stored payloads.

    Revisits come with the payload that they refer to. A stored payload that no longer has its digest fails the read.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")
    )
    headers = spark.read.schema("digest string, header string").parquet(f"{path}/headers")
    return headers.join(stored.select("digest", sound.alias("payload")), "digest").select("header", "payload")


def parse_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Fields of the record headers next to length and digest of the full payloads."""

    def field(name: str, pattern: str = r"([^\r\n]*)") -> Column:
        return F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)

    return records.select(
        field("WARC-Record-ID", "<urn:page:(.*)>").try_cast(id_type).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(.*)>").try_cast(id_type).alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("header_digest"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write plain WARC files: each record is its header, its payload unless it is a revisit, and two line ends."""
    body = F.when(F.col("header").contains(f"{EOL}WARC-Type: revisit{EOL}"), "").otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat("header", body)).write.option("lineSep", EOL + EOL).text(path)


ARCHIVE_SQL = """
WITH content AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
described AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex,
         max(page_id) OVER (PARTITION BY payload) AS response_id
  FROM content),
coded AS (
  SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1), '' ORDER BY i)
             FROM range(32) t(i)) AS payload_digest
  FROM described)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN NULL ELSE response_id END AS refers_to
FROM coded
"""
