"""WARC archives: writing captures, and transaction assembly on reading.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the response in
WARC-Concurrent-To, and a revisit names the response with its payload in WARC-Refers-To. Each record is a gzip member of
its own. Spark's text writer lays the members down, so commits and retries are Spark's: the writer's line separator is a
zero byte, which is also the last byte of a member (the high byte of its size), so each member is handed over without it.
Reading takes archive files (cut at a number of bytes) member by member and joins the three records of a transaction
through their identifiers into one nested row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

END = "\r\n\r\n"
#: captures with shorter payloads are stored whole each time
LEAST_REVISIT = 100
#: bytes of an archive file at most (one capture may have more), of a run of captures that is written at once, and of payloads in a batch that is read
FILE_BYTES, RUN_BYTES, BATCH_BYTES = 64 << 20, 4 << 20, 8 << 20
#: bytes that a capture has besides its payload and three times its address, at most
HEADERS = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(kind: str, page_id: Column) -> Column:
    """A stable record identifier: a hash of kind and page in the form of a UUID."""
    h = F.md5(F.concat_ws(":", F.lit(kind), page_id.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, date: Column, fields: list[tuple[str, Column]], body: Column, body_type: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), *fields, ("Content-Type", F.lit(body_type)), ("Content-Length", F.octet_length(body).cast("string"))])]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)  # concat_ws leaves out null lines


def _members(run_bytes: int):
    """(three records) -> runs of gzip members, a capture whole in one; the last byte of a run (zero) is left to the writer."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(len(batch)):
                members = []
                for column in batch.columns:
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = memoryview(column[i].as_buffer())
                    members.append(pack.compress(raw) + pack.flush())
                    if members[-1][-1]:  # a record of 16 MiB or more: an empty member ends it with a zero byte
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        members.append(pack.compress(b"") + pack.flush())
                one = sum(map(len, members))
                if held and size + one > run_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
                held += members
                size += one
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, per_file: int | None = None) -> None:
    """Write (page_id, url, html) as WARC files of gzip members, each file at most ``file_bytes`` long unless a single capture is longer, and of ``per_file`` captures at most if given.

    Of records with equal payloads of LEAST_REVISIT bytes or more, the one with the least page_id is a response and the
    others revisit it. A null html is an empty payload, a null url an empty target; a null page_id is stored as none and
    is never referred to. Rows that repeat a page_id are captures of their own, told apart by url and payload digest (of
    those with the least page_id all are responses, and the first by url is named); wholly equal rows give equal records.
    Other columns are left out. An empty table gives archives without records.
    """
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    light = rows.where((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("digest", "page_id", "url")
    first = light.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = light.join(first, "digest").where(F.col("page_id") != F.col("first.page_id")).select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"), "first").distinct()
    rows = rows.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("url") == F.col("u")) & (F.col("digest") == F.col("d")), "left")
    again, page, uri, when = F.col("first").isNotNull(), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), F.lit(date)
    response = _id("response", F.concat_ws("|", page, "url", "digest"))
    own = F.concat_ws("|", page, "url", "digest")
    to = _id("response", F.concat_ws("|", F.col("first.page_id").cast("string"), F.col("first.url"), "digest"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    end = F.lit(END)
    records = rows.select(
        F.concat(_record("request", _id("request", own), uri, when, [("WARC-Concurrent-To", response)], F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")), "application/http; msgtype=request"), end).alias("request"),
        F.concat(_record(
            F.when(again, "revisit").otherwise("response"), response, uri, when,
            [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Profile", F.when(again, PROFILE)), ("WARC-Refers-To", F.when(again, to))],
            F.when(again, head).otherwise(F.concat(head, "html")), "application/http; msgtype=response",
        ), end).alias("response"),
        F.concat(_record("metadata", _id("metadata", own), uri, when, [("WARC-Concurrent-To", response)], F.concat(F.lit("page-id: "), page, F.lit("\r\n")), "application/warc-fields"), end).alias("metadata"),
    )
    # a file is so many runs of captures, each as long as the longest capture may be at most; a gzip member is hardly longer than what it holds
    longest = pages.agg(F.max(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    together = 1 if per_file else min(RUN_BYTES, file_bytes)
    runs = max(1, file_bytes // max(together, int(1.001 * longest) + HEADERS))
    members = records.mapInArrow(_members(together), "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", min(runs, per_file or runs)).text(path)


FIELDS = "record_id string, record_type string, concurrent_to string, target_uri string, date string, refers_to string, page_id long, payload binary, payload_bytes long, payload_digest string"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of a WARC record; ValueError on a broken one."""
    if raw[:5] != b"WARC/":
        raise ValueError("no WARC record")
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    return headers, raw[end + 4 : end + 4 + size]


def parse_records(raw: bytes):
    """(headers, block) of each record of a WARC file whose records are gzip members, one in memory at a time."""
    at = 0
    while at < len(raw):
        one, parts = zlib.decompressobj(31), []
        view = memoryview(raw)
        while not one.eof:  # in pieces, so that what is left over is never copied whole
            if at >= len(raw):
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(view[at : at + 65536]))
            at += min(65536, len(raw) - at)
        at -= len(one.unused_data)
        if record := b"".join(parts):
            yield parse_record(record)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    page = next((int(v) for k, _, v in (x.partition(": ") for x in block.decode().split("\r\n")) if k == "page-id" and v), None) if kind == "metadata" else None
    known = [headers.get(f"warc-{name}") for name in ("record-id", "type", "concurrent-to", "target-uri", "date", "refers-to")]
    return (*known, page, payload if with_payload else None, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest())


def _read(with_payload: bool):
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in FIELDS.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in parse_records(memoryview(content.as_buffer())):
                    rows.append(_row(headers, block, with_payload))
                    size += 512 + (len(block) if with_payload else 0)
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record; payload_bytes and payload_digest are taken from what was read, also without the payload itself.

    A task holds one file, a record and a batch of some BATCH_BYTES. Files of 2 GiB and more are refused by Spark; a member
    that is cut off or is no record ends the job with an error.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(with_payload), FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response and metadata joined through concurrent-to identifiers.

    A response or revisit without request or metadata has null there. A revisit's payload size and digest are those of
    the response that its WARC-Refers-To names, null if there is none. Responses that repeat an identifier are captures
    each, with the same request and metadata. Returns capture_id, page_id, request, response, metadata (structs).
    """
    main = records.where("record_type in ('response', 'revisit')")
    side = lambda kind: records.where(F.col("record_type") == kind).select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "date", "page_id").alias(kind)).dropDuplicates(["capture_id"])
    own = F.struct("payload_bytes", "payload_digest")
    first = main.where("record_type = 'response'").select(F.col("record_id").alias("named"), own.alias("whole")).dropDuplicates(["named"])
    # only revisits look for what they refer to
    seen = main.where("record_type = 'revisit'").join(first, F.col("refers_to") == F.col("named"), "left").select(*main.columns, "whole")
    both = main.where("record_type = 'response'").withColumn("whole", own).unionByName(seen)
    response = F.struct("record_id", "record_type", "target_uri", "date", "refers_to", "payload", F.col("whole.payload_bytes").alias("payload_bytes"), F.col("whole.payload_digest").alias("payload_digest"))
    captures = both.select(F.col("record_id").alias("capture_id"), response.alias("response"))
    return captures.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left").select("capture_id", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """The contract query: every page written to WARC and read back; refers_to is the page of the response that a revisit names."""
    path = f"{shared_dir(spark)}/strandlake-warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # the archives are parsed once; what is joined are records without payloads
    records = materialize(read_records(spark, path, with_payload=False), "warc-records")
    captures = materialize(assemble(records).select("capture_id", "page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to").alias("named")), "warc-captures", (records,))
    first = captures.where("record_type = 'response'").select(F.col("capture_id").alias("named"), F.col("page_id").alias("refers_to")).dropDuplicates(["named"])
    revisits = captures.where("record_type = 'revisit'").join(first, "named", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return captures.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(revisits.select(*names))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page IS NULL OR first_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM f
"""
