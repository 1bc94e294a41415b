"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the request, the response (or a revisit of an equal payload) and metadata. Request and
metadata name the response in WARC-Concurrent-To. Archives are text files whose line separator is the blank line that
ends a record, so Spark's own writer commits them, gzipped, and a lost task leaves nothing behind. Records are read
by their Content-Length, whatever the payload holds. Transactions are assembled by joining requests and
metadata to responses through the concurrent-to identifiers; one nested row per capture comes out.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warehaul.llm.common import Batches

#: Payloads from this size on are written once; equal ones revisit it.
REVISIT_BYTES = 1000
#: Bounds the size of an archive, together with the size of partitions.
RECORDS_PER_FILE = 30_000
DATE = "2026-01-01T00:00:00Z"
_BATCH_BYTES = 8 << 20

RECORD = (
    "record_id string, type string, target string, concurrent_to string, refers_to string, payload_digest string, "
    "http string, block binary"
)


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ``html``) with payload, digest, copy number and the page it revisits.

    Of equal payloads of at least ``revisit_bytes`` the row with the largest page_id (the first copy of it) is the
    response, the others revisit it. Null html is an empty payload. Groups are found on narrow rows; the payloads
    are dealt by page, so that no group of copies meets in one task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    # a page without an id has one as text, so that the join and the copies below share plain keys and one shuffle
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    rows = rows.withColumns(
        {"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("bigint"), "page": page}
    )
    narrow = rows.filter(F.col("bytes") >= revisit_bytes).groupBy("digest", "page", "page_id").agg(F.count("*").alias("n"))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("original"), F.sum("n").alias("n")).filter("n > 1")
    grouped = narrow.select("digest", F.col("page").alias("member")).join(
        groups.select(F.col("digest").alias("shared"), "original"), F.col("digest") == F.col("shared")
    )
    mine = grouped.select(F.col("digest").alias("held"), "member", "original")
    same = (F.col("digest") == F.col("held")) & (F.col("page") == F.col("member"))
    joined = rows.join(mine, same, "left")
    copies = Window.partitionBy("digest", "page").orderBy("url")
    return joined.withColumn("copy", F.row_number().over(copies)).withColumn(
        "revisits", F.col("held").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("original")) & (F.col("copy") == 1))
    )


def _id(page: Column, digest: Column, copy: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), copy.cast("string"), F.lit(f":{kind}>"))


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(*lines, size, block)


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a request, a response or revisit, and metadata per row of ``pages`` as gzipped archives below ``path``.

    Line breaks in a URL are percent-encoded; a null URL has no WARC-Target-URI. Repeated rows are captures of
    their own. An empty table writes an empty archive.
    """
    rows = planned(pages, revisit_bytes)
    page, digest, copy = F.col("page_id"), F.col("digest"), F.col("copy")
    answer = _id(page, digest, copy, "response")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-z]+://([^/?#]*)", 1)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _id(page, digest, copy, "request")), *common,
         ("WARC-Concurrent-To", answer), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    original = F.when(F.col("revisits"), _id(F.col("original"), digest, F.lit(1), "response"))
    response = _record(
        [("WARC-Type", F.when(F.col("revisits"), "revisit").otherwise("response")), ("WARC-Record-ID", answer), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("WARC-Refers-To", original),
         ("WARC-Profile", F.when(F.col("revisits"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("Content-Type", "application/http; msgtype=response")],
        F.concat(http, F.when(F.col("revisits"), F.lit("")).otherwise(F.col("payload"))),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _id(page, digest, copy, "metadata")), *common,
         ("WARC-Concurrent-To", answer), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n")),
    )
    lines = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    writer = lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def _unzipped(raw: bytes) -> bytes:
    """The bytes of all gzip members; bytes that are not gzipped as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    parts = []
    while raw:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(raw) + member.flush())
        raw = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def _parsed(raw: bytes):
    """Records of an archive as tuples of RECORD; the block of HTTP records is split from its header."""
    at = 0
    while (begin := raw.find(b"WARC/", at)) >= 0:
        stop = raw.index(b"\r\n\r\n", begin)
        fields = {}
        for line in raw[begin:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        block = raw[stop + 4 : stop + 4 + int(fields[b"content-length"])]
        at = stop + 4 + len(block)
        head = None
        if fields.get(b"content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            head = head.decode("utf-8", "replace")
        named = (b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-concurrent-to", b"warc-refers-to", b"warc-payload-digest")
        yield (*map(fields.get, named), head, block)


def _read(batches: Batches) -> Batches:
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for files in batches:
        for raw in files.column(0):
            rows, size = [], 0
            for row in _parsed(_unzipped(raw.as_py())):
                rows.append(row)
                size += len(row[-1]) + 500
                if size >= _BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, see RECORD. A task holds one archive at a time."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, RECORD)


def digested(records: DataFrame) -> DataFrame:
    """``records`` with ``block_sha1`` and ``block_bytes``, without the blocks of responses.

    For those who want digests of payloads and not the payloads: these then need not be shuffled.
    """
    answer = F.col("type") == "response"
    return records.withColumns(
        {
            "block_sha1": F.when(answer, F.sha1("block")),
            "block_bytes": F.octet_length("block").cast("bigint"),
            "block": F.when(~answer, F.col("block")),
        }
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response``, ``request``, ``metadata`` and how many of the latter two there were.

    The nested rows have the columns of ``records``: those of RECORD, or of ``digested``.

    Requests and metadata meet their response or revisit through WARC-Concurrent-To. Of several the one with
    the smallest id is shown, so that no group is collected. Those without a response give a row with a null one; a response
    without them has nulls and counts of zero. Records of other types are left out.
    """
    fields = records.columns
    kind = F.col("type")
    side = records.filter(kind.isin("request", "metadata"))
    one = lambda name: F.when(kind == name, F.struct(*fields))
    sides = side.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        F.min(one("request")).alias("request"),
        F.min(one("metadata")).alias("metadata"),
        F.count_if(kind == "request").alias("n_requests"),
        F.count_if(kind == "metadata").alias("n_metadata"),
    )
    answers = records.filter(kind.isin("response", "revisit")).select(F.struct(*fields).alias("response"))
    joined = answers.join(sides, answers["response.record_id"] == sides["capture"], "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_requests", "n_metadata")]
    return joined.select("response", "request", "metadata", *counts)


def pages_of(captures: DataFrame) -> DataFrame:
    """Per capture of ``digested`` records: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A revisit has the digest and the length that its own record states of the full payload.
    """
    answer = F.col("response")
    revisit = answer["type"] == "revisit"
    stated = F.regexp_extract(answer["http"], r"(?i)\ncontent-length: *([0-9]+)", 1)
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("bigint")
    return captures.select(
        number(F.col("metadata.block").cast("string"), r"page-id: ([-0-9]+)").alias("page_id"),
        F.when(revisit, stated.cast("bigint")).otherwise(answer["block_bytes"]).alias("payload_bytes"),
        F.when(revisit, F.replace(answer["payload_digest"], F.lit("sha1:"), F.lit(""))).otherwise(answer["block_sha1"]).alias("payload_digest"),
        answer["type"].alias("record_type"),
        number(answer["refers_to"], "^<urn:page:([-0-9]+):").alias("refers_to"),
    )
