"""Operator 9: deduplicated WARC archives with revisit resolution.

*Writing.*  Payload digests are found where the pages are read; only headers (digest,
length, page_id) are shuffled to find, for each digest of ``least_bytes`` or more, the
page with the largest page_id (partial maxima before the shuffle, so a payload that a
third of all pages share costs one row a task).  Pages join that table: the winner is
written as ``response`` with its payload, the others as ``revisit`` without payload that
refer to it.  Records are built by SQL functions and written by Spark's text writer with
the record separator as line separator, gzip-compressed, in files of bounded size.

*Reading.*  Files are read whole (their size is bounded at writing) and parsed by
Content-Length.  Revisit records are then joined to the original responses by record id, so
that the payload length and digest of every page come back out of the archives.

*Deduplicating.*  :func:`deduplicate` takes archives, revisits among them, of any writer.
Headers alone are shuffled by payload digest to find each digest's original, the response of
the earliest date (ties: smallest record id); all records join it.  Revisits refer to that original,
later responses of ``least_bytes`` or more become revisits, and everything is written with fresh
record ids and lengths; dates, addresses and HTTP headers stay.  A revisit whose original is in
none of the archives stays with the reference it came with; records that share the original's
id and payload are all responses; requests, metadata and other kinds of record are not read.

Defined results: null html -> empty payload; payloads under ``least_bytes`` are always
responses; several rows with the winning page_id and payload are all responses; a null
page_id never wins over another (all-null groups are responses); repeated rows come out
as often as they occur; an empty table gives archives without records and no rows; payloads of any length are
written whole; other columns are not read, whatever their names.  A revisit whose original is missing keeps null length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tune

CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH = 64


def _urn(*parts: Column) -> Column:
    """A name-based URN; a response's name is its page_id and digest, so that revisits can state it."""
    h = F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def resolve(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The writer's decisions.

    The table of winners is written, so that the join has an exchange on either side and
    Spark can split the rows of a payload that very many pages share.

    Columns: ``pages(page_id, url, html)`` and payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    known = pages.select(
        "page_id", "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    first = (
        known.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("payload_digest", "first_id")
    )
    first = Scratch(pages.sparkSession, "warc").put(first, "first")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write(pages: DataFrame, path: str, least_bytes: int = 1000, file_bytes: int = 8_000_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives under ``path``: one record for each row of ``pages(page_id, url, html)``."""
    spark = pages.sparkSession
    tune(spark)
    r = resolve(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)
    revisit = F.col("record_type") == "revisit"
    r = r.select(
        "record_type", "page_id", "url", "payload", "payload_digest", F.lit(date).alias("date"), F.lit(_HTTP).alias("http"),
        _urn(F.col("page_id"), F.col("payload_digest"), F.when(revisit, F.lit("revisit"))).alias("record_id"),
        F.when(revisit, _urn(F.col("refers_to"), F.col("payload_digest"), F.lit(""))).alias("refers_to"),
    )
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit("")))).alias("m")).first()["m"] or 0
    _save(r, path, mean, file_bytes)


def _save(r: DataFrame, path: str, mean: float, file_bytes: int) -> None:
    """Archives of ``r(record_type, page_id, url, payload, payload_digest, date, http, record_id, refers_to)``."""
    line = lambda name, value: F.concat(F.lit(f"{CRLF}{name}: "), value)
    optional = lambda name, column: F.when(F.col(column).isNotNull(), line(name, F.col(column))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    digest = F.concat(F.lit("sha1-hex:"), F.col("payload_digest"))
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "")
    record = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", url),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.coalesce(line("WARC-Payload-Digest", digest), F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit(_PROFILE))).otherwise(""),
        optional("WARC-Refers-To", "refers_to"),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF + CRLF),
        body,
    )
    # Files are bounded by rows: as many as of the mean size make file_bytes.
    rows = max(1, int(file_bytes // (mean + 600)))
    (
        r.select(record.alias("value")).write.mode("overwrite").format("text")
        .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", rows).save(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        head = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end after its block")
        at = end + 8 + size


def digest_of(value: str | None) -> str | None:
    """Hex form of a SHA-1 payload digest in any of the usual forms; null for other digests."""
    kind, _, text = (value or "").partition(":")
    if kind == "sha1-hex" or (kind == "sha1" and len(text) == 40):
        return text.lower()
    return base64.b32decode(text.upper()).hex() if kind == "sha1" else None


_FIELDS = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
    ("payload", pa.binary()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("http", pa.binary()),
])


def _record(head: dict[str, str], block: bytes) -> tuple:
    kind, digest = head["warc-type"], digest_of(head.get("warc-payload-digest"))
    http, mark, payload = block.partition(b"\r\n\r\n")
    whole = kind == "response"
    if whole:
        own = hashlib.sha1(payload).hexdigest()
        if digest not in (None, own):
            raise ValueError("a payload does not have its digest")
        digest = own
    page = head.get("x-page-id")
    return (
        int(page) if page else None, kind, digest, len(payload) if whole else None, head.get("warc-refers-to"),
        payload if whole else None, head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-date"), http + mark,
    )


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every response and revisit under ``path``: record_id, page_id, record_type, payload_digest, payload_bytes and payload (null for a
    revisit), refers_to (a record_id), url, date and http (the HTTP head)."""
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out: list[tuple] = []
                for head, block in parse(gzip.decompress(content.as_buffer())):
                    if head["warc-type"] in ("response", "revisit"):
                        out.append(_record(head, block))
                    if len(out) == _BATCH:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    schema = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary, record_id string, url string, date string, http binary"
    return files.mapInArrow(run, schema)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIELDS)], schema=_FIELDS)


def deduplicate(spark: SparkSession, sources: str | list[str], path: str, least_bytes: int = 1000, file_bytes: int = 8_000_000) -> None:
    """Archives under ``path`` that hold each payload of ``least_bytes`` or more of the archives ``sources`` once."""
    tune(spark)
    found = records(spark, sources)
    scratch = Scratch(spark, "warc")
    heads = scratch.put(found.select("record_id", "record_type", "payload_digest", "payload_bytes", F.coalesce("date", F.lit("")).alias("date")), "heads")
    # one row a digest (smallest, before the shuffle too); written, so that Spark can split a digest that very many records share
    first = heads.where("record_type = 'response'").groupBy("payload_digest").agg(F.min(F.struct("date", "record_id")).alias("f"))
    first = scratch.put(first.select("payload_digest", F.col("f.record_id").alias("first_id")), "first")
    fresh = lambda record_id, digest: _urn(record_id, digest, F.lit("fresh"))
    later = (F.col("payload_bytes") >= least_bytes) & (F.col("record_id") != F.col("first_id"))
    revisit = (F.col("record_type") == "revisit") | later
    out = found.join(first, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "url", F.col("payload").cast("string").alias("payload"), "payload_digest",
        F.coalesce("date", F.lit("1970-01-01T00:00:00Z")).alias("date"), F.col("http").cast("string").alias("http"),
        fresh(F.col("record_id"), F.col("payload_digest")).alias("record_id"),
        F.when(revisit, F.when(F.col("first_id").isNotNull(), fresh(F.col("first_id"), F.col("payload_digest"))).otherwise(F.col("refers_to"))).alias("refers_to"),
    )
    mean = heads.agg(F.avg(F.coalesce("payload_bytes", F.lit(0))).alias("m")).first()["m"] or 0
    _save(out, path, mean, file_bytes)
    scratch.drop("heads", "first")


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of all records; a revisit's
    length and page come from the response whose record id it states."""
    scratch = Scratch(found.sparkSession, "warc")
    heads = scratch.put(found.drop("payload", "http", "url", "date"), "heads")
    asked = heads.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    originals = (
        heads.where("record_type = 'response'").join(asked, "record_id", "left_semi").dropDuplicates(["record_id"])
        .select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original_id"), F.col("payload_bytes").alias("original_bytes"))
    )
    return heads.join(scratch.put(originals, "originals"), "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original_id").alias("refers_to")
    )
