"""Content-addressed web archive.

A page becomes a WARC 1.1 record whose payload is the page in UTF-8. The archive keeps two tables: `payloads` holds each
distinct payload once, under its SHA-256 digest; `headers` holds for each record the exact bytes that stand before the
payload, with the digest that names it. Joining the two gives back every record byte for byte.

Of records with equal payloads of at least `min_bytes` bytes, the one with the largest page_id is the response; the
others are revisits that name it and carry no payload of their own. Smaller records are all responses. Their payload too
is stored once.

Reading rebuilds the records by that join and takes length and digests from their bytes: the payload's SHA-256 against its
address, its SHA-1 and length against the header, the end of the record. A revisit has no payload of its own and is held
against the rebuilt response of the same payload. `verify` lists what does not agree; `read` fails on it.

Equal payloads are found by digest, with sums made before the shuffle, so a payload that a third of all pages share is
one row after it. Bytes are shuffled once to be stored and once to rebuild the responses; a payload of `min_bytes` has one
response, and the many responses of a smaller one are spread over salted copies of that payload.

Defined results. A null html is an empty payload; a null url is an empty target. A null page_id is less than any other: it
is the response only if no equal payload has an id, and refers_to is then null for the others. Rows that repeat (same id
and payload) are records of their own, alike in all; when they hold the largest id, all of them are responses. An empty
table gives an empty archive; extra columns are not read. Very long pages are one payload each, as whole values in a task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inswing.llm.common import folder, stage, text_of, tidy

MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"  # the tables hold no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
TAIL = END + END  # after the payload
SALT = 32  # copies of a small payload that responses are dealt to


def _line(name: str, *value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), *value, F.lit(END))


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def header(page: Column, url: Column, kind: Column, sha1: Column, size: Column, refers: Column, refers_url: Column) -> Column:
    """The bytes of a record before its payload. A url may hold no line break, or it would end its header line."""
    revisit = kind == "revisit"
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END + END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(size)
    return F.concat(
        F.lit("WARC/1.1" + END), _line("WARC-Type", kind), _line("WARC-Record-ID", _uri(page)), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", clean(url)), _line("WARC-Payload-Digest", F.lit("sha1:"), sha1),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _uri(refers)),
                                 _line("WARC-Refers-To-Target-URI", clean(refers_url)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", block.cast("string")), F.lit(END), http,
    ).cast("binary")


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the archive: path/payloads and path/headers."""
    payload = text_of(pages["html"]).cast("binary")
    read = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), payload.alias("payload"))
    facts = stage(read.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"),
                              F.octet_length("payload").cast("long").alias("size")), "warc-facts")
    first = stage(facts.groupBy("digest").agg(F.max("page_id").alias("holder")), "warc-holders")
    url_of = stage(
        facts.join(first, (facts["digest"] == first["digest"]) & facts["page_id"].eqNullSafe(first["holder"]))
        .groupBy(facts["digest"]).agg(F.min("url").alias("holder_url")), "warc-holder-urls")
    known = stage(first.join(url_of, "digest", "left"), "warc-known")
    revisit = (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    kind = F.when(revisit, "revisit").otherwise("response")
    (facts.join(known, "digest").withColumn("kind", kind)
     .select("page_id", "digest", header(F.col("page_id"), F.col("url"), F.col("kind"), F.col("sha1"), F.col("size"), F.col("holder"), F.col("holder_url")).alias("header"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))
    # sorted and thinned out in each task first
    with tidy(pages.sparkSession):
        (read.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
         .write.option("compression", "zstd").parquet(f"{path}/payloads"))


def records(spark: SparkSession, path: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, header, record): every record rebuilt; a revisit has no payload in it. The record is null if its payload is missing."""
    h, p = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    revisit = field(F.col("header"), "WARC-Type") == "revisit"
    small = F.octet_length("payload") < min_bytes
    dealt = p.select(F.col("digest").alias("address"), "payload", F.explode(F.when(small, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    few = _said(F.col("header")) < min_bytes
    full = h.where(~revisit).withColumn("salt", F.when(few, F.pmod(F.xxhash64("header"), F.lit(SALT)).cast("int")).otherwise(0))
    joined = full.join(dealt, (F.col("digest") == F.col("address")) & (F.col("salt") == F.col("copy")), "left")
    tail = F.lit(TAIL).cast("binary")
    return joined.select("digest", "header", F.concat("header", "payload", tail).alias("record")).unionByName(
        h.where(revisit).select("digest", "header", F.concat("header", tail).alias("record")))


def _said(head: Column) -> Column:
    """The payload's length as the header states it."""
    return F.regexp_extract(F.decode(head, "UTF-8"), r"HTTP/1\.1 200 OK\r\n(?:[^\r\n]+\r\n)*Content-Length: ([0-9]+)", 1).try_cast("long")


def field(head: Column, name: str) -> Column:
    """The value of a header field; null where there is none."""
    got = F.regexp_extract(F.decode(head, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(got == "", None).otherwise(got)


def _page(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each record, and `sound`: whether digests and lengths agree with the rebuilt bytes."""
    head, record = F.col("header"), F.col("record")
    before, ending = F.octet_length(head), F.lit(len(TAIL))
    body = F.substr(record, before + 1, F.octet_length(record) - before - ending)
    rebuilt = records(spark, path).select("digest", "header", body.alias("body"), F.substr(record, F.octet_length(record) - ending + 1, ending).alias("tail"))
    facts = rebuilt.select(
        _page(field(head, "WARC-Record-ID")).alias("page_id"), field(head, "WARC-Type").alias("record_type"), "digest",
        F.regexp_replace(field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), _page(field(head, "WARC-Refers-To")).alias("refers_to"),
        _said(head).alias("payload_bytes"), F.sha1("body").alias("found_sha1"), F.octet_length("body").cast("long").alias("found_bytes"),
        ((F.sha2("body", 256) == F.col("digest")) & (F.col("tail") == F.lit(TAIL).cast("binary"))).alias("whole"))
    with tidy(spark):
        facts = stage(facts, "warc-rebuilt")
    response = F.col("record_type") == "response"
    agrees = (F.col("payload_digest") == F.col("found_sha1")) & (F.col("payload_bytes") == F.col("found_bytes"))
    said = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = facts.where(response).select(*said, F.coalesce(F.col("whole") & agrees, F.lit(False)).alias("sound"))
    held = facts.where(response).groupBy("digest").agg(F.min("whole").alias("held_whole"), F.min("found_sha1").alias("held_sha1"), F.min("found_bytes").alias("held_bytes"))
    bare = (F.col("found_bytes") == 0) & F.col("held_whole") & (F.col("payload_digest") == F.col("held_sha1")) & (F.col("payload_bytes") == F.col("held_bytes"))
    other = facts.where(~response).join(held, "digest", "left").select(*said, F.coalesce(bare, F.lit(False)).alias("sound"))
    return own.unionByName(other)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The records whose payload is missing or is not what header and address say."""
    return checked(spark, path).where(~F.col("sound"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; the query fails on a payload that is not what header and address say."""
    sound = F.when(F.col("sound"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    return checked(spark, path).withColumn("payload_digest", sound).drop("sound")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive `pages` and read the archive back."""
    path = folder(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
