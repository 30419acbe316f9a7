"""Content-addressed WARC archive: payload bytes once by verified digest, exact headers apart, records by join."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import Scratch, hot_keys, salted, table

VERSION, BREAK = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Time of capture of pages that tell none.
DATE = "2000-01-01T00:00:00Z"


def _payload() -> F.Column:
    return F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))


def headers(pages: DataFrame, least: int = 1000, date: str = DATE) -> DataFrame:
    """A WARC header and HTTP header for each page (page_id, url, html), with its payload's digests.

    Rows: page_id, header (exact bytes up to the payload: the WARC header, then the HTTP header of the block), sha256 and
    sha1 (hex), payload_bytes, record_type. Payload: html in UTF-8, null as empty. Among equal payloads of ``least``
    bytes or more the largest page_id is a response, the others revisit it and hold the HTTP header alone; smaller payloads
    are all responses. Rows repeated with one page_id: each is a record; null page_ids are smaller than all others. An
    empty table gives an empty archive; other columns are ignored, whatever their names. Equality is that of SHA-256;
    readers verify the bytes against both digests. Rows of a very common payload are dealt to many tasks.
    """
    box = Scratch(pages.sparkSession, "warc")
    p = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), _payload().alias("payload"))
    p = box.save(p.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")), "digests")
    owner = p.where(F.col("payload_bytes") >= least).groupBy("sha256").agg(F.max("page_id").alias("owner"))
    p = salted(p, owner, "sha256", hot_keys(p, "sha256"), F.col("page_id"))
    revisit = F.col("owner").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("owner")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    uid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK * 2))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(VERSION + BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uid(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uid(F.col("owner"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(BREAK), http,
    )
    return p.select("page_id", head.cast("binary").alias("header"), "sha256", "sha1", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"))


def payloads(pages: DataFrame) -> DataFrame:
    """sha256, payload: each distinct payload once (each task drops its own copies before the shuffle)."""
    p = pages.select(_payload().alias("payload"))
    return p.select(F.sha2("payload", 256).alias("sha256"), "payload").dropDuplicates(["sha256"])


def write_archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Writes ``path``/headers and ``path``/payloads. An existing archive is an error."""
    headers(pages, least).select("page_id", "header", "sha256", "record_type").write.parquet(f"{path}/headers")
    payloads(pages).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark, path: str) -> DataFrame:
    """page_id, record, payload: whole WARC records (header, block, two line ends), rebuilt by a join on the digest, and
    their payloads: a revisit's is that of the record it refers to.

    Every payload is hashed again; one whose digest is not its address, or a header without payload, raises.
    """
    h, p = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    p = p.select("sha256", "payload", (F.sha2("payload", 256) == F.col("sha256")).alias("ok"))
    r = salted(h, p, "sha256", hot_keys(h, "sha256"), F.col("page_id"))
    given = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    whole = F.concat("header", given, F.lit(BREAK * 2).cast("binary"))
    altered = F.raise_error(F.concat(F.lit("payload missing or altered: "), "sha256")).cast("binary")
    return r.select("page_id", F.when(F.coalesce("ok", F.lit(False)), whole).otherwise(altered).alias("record"), "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, payload (binary), payload_digest, payload_bytes, record_type, refers_to, read from the record bytes.

    The header ends at the first empty line; the block is the Content-Length bytes after it, and a response's payload is
    what follows the block's own header. A record whose lengths or digests are wrong raises.
    """
    size, gap = F.octet_length("record"), F.lit(BREAK * 2)
    # headers are ASCII or UTF-8 without control bytes, and short: byte positions are found in their Latin-1 view
    r = records.withColumn("cut", F.position(gap, F.decode("record", "ISO-8859-1")))
    r = r.withColumn("http", F.position(gap, F.decode("record", "ISO-8859-1"), F.col("cut") + 4))
    r = r.withColumn("head", F.decode(F.expr("substring(record, 1, cut + 1)"), "UTF-8"))
    field = lambda name: F.regexp_extract("head", rf"(?m)^{re.escape(name)}: (.*?)\r?$", 1)
    r = r.withColumn("length", field("Content-Length").cast("long")).withColumn("type", field("WARC-Type"))
    inside = F.expr("substring(record, http + 4, cast(length - (http - cut) as int))")
    whole = (F.col("cut") > 0) & (F.col("http") > 0) & (size == F.col("cut") + 3 + F.col("length") + 4)
    digest = F.sha1("payload")
    told = F.lower(F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""))
    same = F.when(F.col("type") == "response", inside == F.col("payload")).otherwise(F.octet_length(inside) == 0)
    return r.select(
        "page_id", "payload",
        F.when(whole & same & (digest == told), digest).otherwise(F.raise_error(F.lit("a record's length or digest is wrong"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.col("type").alias("record_type"),
        F.try_to_number(F.nullif(F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long").alias("refers_to"),
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Writes the records' bytes as WARC files: one part file a partition. Records end in two line ends, which is what the
    text writer puts behind a row; headers and html are UTF-8."""
    end = F.octet_length("record") - len(BREAK * 2)
    records.select(F.decode(F.substring("record", F.lit(1), end), "UTF-8")).write.option("lineSep", BREAK * 2).text(path)


def op4_warc_archive(spark, sf_dir: str) -> DataFrame:
    box = Scratch(spark, "warc")
    path = f"{box.base}/archive"
    write_archive(table(spark, sf_dir, "pages"), path)
    return parse_records(read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS owner FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN owner IS NOT NULL AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner IS NOT NULL AND page_id < owner THEN owner END AS refers_to
FROM o
"""

QUERIES = {"op4_warc_archive": op4_warc_archive}
SQL = {"op4_warc_archive": OP4_SQL}
