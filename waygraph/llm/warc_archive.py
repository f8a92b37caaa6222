"""A content-addressed web archive.

A payload's bytes are stored once under their SHA-256, and every record's exact
header bytes are kept apart with that digest.  Joining the two tables gives back
the original records, byte for byte, as WARC/1.1.  Both tables are Parquet
folders, so they live on whatever storage the cluster has.  An archive is read by
rebuilding every record and parsing its bytes; payloads are checked against their
strong digest, and lengths and payload digests against what the headers say.  An
error is raised for any that fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import join_groups
from waygraph.plans.stages import materialise, shared_dir, table

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 as 32 bare upper-case base32 characters: 15, 15 and 10 hex digits are 12, 12 and 8 of them."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(page: Column, digest: Column) -> Column:
    """Named by page and payload, so pages that share an id with other payloads differ."""
    h = F.md5(F.concat(F.lit("page|"), F.coalesce(page.cast("string"), F.lit("null")), F.lit("|"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(page: Column, url: Column, size: Column, digest: Column, sha1: Column, first: Column, date: str) -> Column:
    revisit = ~page.eqNullSafe(first)
    clean = F.regexp_replace(F.coalesce(url, F.lit("urn:unknown")), r"[\r\n]", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page, digest)),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(first, digest))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "UTF-8")


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``folder/payloads`` (digest, payload) and ``folder/records`` (page_id, digest, url, header).

    Null html is an empty payload.  The url is kept as it came; in the header a null one
    has a placeholder, and line breaks in one are escaped.  Of pages with
    equal payloads of at least ``least`` bytes the one with the largest id is the
    response (ids that are null rank lowest) and others revisit it; smaller
    payloads are all responses.  Rows that repeat an id and a payload are archived
    as they come; an id that repeats with other payloads gives records of their own.
    An empty table gives an empty archive.  Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    base.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    thin = base.select("page_id", "url", "digest", "size", sha1_base32(F.col("payload")).alias("sha1"))
    first = materialise(thin.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")), "warc-groups")
    rows = join_groups(thin, first, "digest", "n", first.agg(F.sum("n")).first()[0] or 0)  # a payload of a third of all pages stays dealt
    target = F.when(F.col("size") >= least, F.col("top")).otherwise(F.col("page_id"))
    header = _header(F.col("page_id"), F.col("url"), F.col("size"), F.col("digest"), F.col("sha1"), target, date)
    rows.select("page_id", "digest", "url", header.alias("header")).write.parquet(f"{folder}/records")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads, each verified against its strong digest as it is read."""
    stored = spark.read.parquet(f"{folder}/payloads")
    bad = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary")
    return stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(bad).alias("payload"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


_END = b"\r\n\r\n"


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, record``: the whole bytes of every record.

    Only responses meet the payloads, and of equal payloads of the least size or more there is one.
    """
    rows = spark.read.parquet(f"{folder}/records").withColumn("response", _field("WARC-Type") == "response")
    own = rows.filter("response").join(_payloads(spark, folder), "digest").select("page_id", "url", F.concat("header", "payload", F.lit(_END)).alias("record"))
    return own.unionByName(rows.filter("not response").select("page_id", "url", F.concat("header", F.lit(_END)).alias("record")))


def _parsed(records: DataFrame) -> DataFrame:
    """Fields, size and digest of the block of each record (``record``), from its bytes; an error where they disagree."""
    head = F.substring_index(F.decode("record", "UTF-8"), _END.decode(), 1)
    rows = records.withColumn("header", F.encode(head, "UTF-8"))
    fields = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "stated": "WARC-Payload-Digest", "length": "Content-Length"}
    rows = rows.select("page_id", "record", F.octet_length("header").alias("at"), *[_field(v).alias(k) for k, v in fields.items()]).withColumn("length", F.col("length").cast("int"))
    block = F.substring(F.col("record"), F.col("at") + len(_END) + 1, F.col("length"))
    whole = F.octet_length("record") == F.col("at") + F.col("length") + 2 * len(_END)
    rows = rows.select("page_id", *fields, block.alias("block"), whole.alias("whole"))
    rows = rows.select("page_id", *fields, "whole", F.octet_length("block").cast("long").alias("payload_bytes"), sha1_base32(F.col("block")).alias("payload_digest"))
    ok = F.col("whole") & (F.col("record_type") == "revisit") | (F.col("whole") & (F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))))
    bad = F.raise_error(F.concat(F.lit("header and block of a record disagree: "), F.col("record_id"))).cast("string")
    return rows.withColumn("record_type", F.when(ok, F.col("record_type")).otherwise(bad)).drop("whole", "length")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri`` from the bytes of the records.

    Sizes and digests are those of each response's block; a revisit takes them, and the page it refers
    to, from the response of the record id it names, whose digest must be the one in its own header.
    """
    rows = materialise(_parsed(reconstruct(spark, folder)), "warc-read")
    own = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    plain = rows.filter("record_type = 'response'")
    revisits = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers", "target_uri", "stated")
    asked = revisits.groupBy("refers").agg(F.count(F.lit(1)).alias("n"))
    facts = plain.groupBy(F.col("record_id").alias("refers")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    facts = materialise(asked.join(facts, "refers", "left"), "warc-responses")
    met = join_groups(revisits, facts, "refers", "n", facts.agg(F.sum("n")).first()[0] or 0)
    bad = F.raise_error(F.concat(F.lit("no response of this payload: "), F.col("refers"))).cast("string")
    met = met.withColumn("record_type", F.when(F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("record_type")).otherwise(bad))
    plain = plain.withColumn("refers_to", F.lit(None).cast(facts.schema["refers_to"].dataType))
    return plain.select(*own, "refers_to", "target_uri").unionByName(met.select(*own, "refers_to", "target_uri"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all pages archived and read back."""
    folder = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).drop("target_uri")
