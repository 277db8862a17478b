r"""Content-addressed WARC archive: payloads stored once, record headers kept apart, records rebuilt by a join.

:func:`write_archive` turns pages into WARC/1.1 records.  The archive is two
Parquet tables in one folder:

* ``payloads`` (digest, payload): every distinct payload once, addressed by its
  SHA-256;
* ``records`` (page_id, digest, header): one row per record with the exact bytes
  of its WARC header block (and HTTP header block) as text.

Of the records with equal payloads of at least ``min_bytes`` bytes the one with
the smallest ``page_id`` is a ``response``, the others are ``revisit`` records
that refer to it; records with smaller payloads are all ``response``.

:func:`read_archive` joins the tables, parses the headers and verifies every
payload against digest and length; :func:`raw_records` rebuilds the bytes of the
original records.

The smallest id per digest is a partially aggregated minimum, payload bytes are
taken from that one row, and joins on the digest have one row per digest on one
side, so a payload shared by a third of all pages is split by the skew-join
rule of Spark.

Defined cases: a null html is an empty payload; null urls give an empty target;
page ids sort with null last, and all rows that share the smallest id of their
payload are ``response``; an empty table gives an empty archive; further columns
of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 100
# fixed values: the profile of revisit records and the date stamped on records without a capture time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
LAST_ID = (1 << 63) - 1   # rank of a null page id: after every other


def _record_id(page_id: Column) -> Column:
    """A stable urn:uuid of a page id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One header line; control characters of the value become percent codes, so a value stays on its line."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF))


def _header() -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    refers = F.when(revisit, F.concat(_field("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                      _field("WARC-Refers-To", _record_id(F.col("first_id"))),
                                      _field("WARC-Refers-To-Page", F.col("first_id")))).otherwise("")
    return F.concat(F.lit("WARC/1.1" + CRLF), _field("WARC-Type", F.col("record_type")),
                    _field("WARC-Record-ID", _record_id(F.col("page_id"))), _field("WARC-Date", F.lit(RECORD_DATE)),
                    _field("WARC-Target-URI", F.coalesce(F.col("url"), F.lit(""))),
                    _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), refers,
                    _field("Content-Type", F.lit("application/http; msgtype=response")),
                    _field("Content-Length", block), F.lit(CRLF), http)


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write the records of ``pages`` (page_id, url, html) as an archive folder."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.coalesce("page_id", F.lit(LAST_ID)).alias("rank")).withColumns(
        {"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    heads = rows.select("page_id", "url", "rank", "digest", "n")
    # hashes of another family and the lengths must agree within a digest before its bytes are stored only once
    check = F.xxhash64("payload")
    groups = (rows.select("rank", "digest", "n", check.alias("x")).groupBy("digest")
              .agg(F.min("rank").alias("first_rank"), F.min("n").alias("n0"),
                   F.max("n").alias("n1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
              .withColumn("rank", F.when((F.col("n0") == F.col("n1")) & (F.col("x0") == F.col("x1")), F.col("first_rank"))
                          .otherwise(F.raise_error(F.concat(F.lit("different payloads share digest "), F.col("digest")))))
              .select("digest", "rank"))
    groups.write.parquet(f"{path}/groups")
    groups = pages.sparkSession.read.parquet(f"{path}/groups")
    records = (heads.join(groups.withColumnRenamed("rank", "first_rank"), "digest")
               .withColumn("first_id", F.nullif("first_rank", F.lit(LAST_ID)))
               .withColumn("record_type", F.when((F.col("n") < min_bytes) | (F.col("rank") == F.col("first_rank")), "response")
                           .otherwise("revisit"))
               .select("page_id", "digest", _header().alias("header")))
    records.write.parquet(f"{path}/records")
    # the row of the smallest id carries the bytes; of repeated rows with that id one is kept
    (rows.select("rank", "digest", "payload").join(groups, ["digest", "rank"], "left_semi")
     .dropDuplicates(["digest", "rank"]).select("digest", "payload").write.parquet(f"{path}/payloads"))


def _value(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records with their full payloads, parsed and verified: page_id, url, record_type, refers_to, digest, payload, header."""
    payloads = (spark.read.parquet(f"{path}/payloads")
                .withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
                            .otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))))))
    records = spark.read.parquet(f"{path}/records").select(
        "page_id", "header", _value("WARC-Target-URI").alias("url"), _value("WARC-Type").alias("record_type"),
        F.expr(r"try_cast(regexp_extract(header, '\r\nWARC-Refers-To-Page: ([^\r\n]*)\r\n', 1) AS bigint)").alias("refers_to"),
        F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1).alias("digest"))
    return records.join(payloads, "digest", "left").withColumn(
        "payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for digest "), F.col("digest"))).cast("binary")))


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of every original record: header, payload (responses only), two line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_archive(spark, path).select(
        "page_id", F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode())).alias("record"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
