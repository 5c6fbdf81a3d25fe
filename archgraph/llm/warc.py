"""WARC archives: written by Spark's text writer, read by Spark's text reader, put together from segments.

Writing: a page becomes an HTTP response in chunked transfer framing; a block of more than SEGMENT_BYTES is cut into a first
record and continuation records that name it as their origin. Records of equal payloads after the chosen one become
revisit records that name it. Files end after FILE_RECORDS rows, so none grows without bound.

Reading: gzip files are not split, so a task gets the lines of a file in order, and a parser takes header lines and then as many
bytes as Content-Length says. Continuations are grouped by origin, ordered by segment number and joined; the total
length that the last one states is verified; the HTTP framing is decoded, of whole records where they are parsed.

Cases: a null payload is empty; payloads may hold any line ends and text that looks like a record; ties of equal payloads
go to the largest id; every row is a record of its own, rows repeated in id and payload included (all of them responses if
their id is the largest); a page without an id is a response; a missing segment or a wrong total length marks the page
`complete` = false; empty tables give no rows; only the columns named in the arguments are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm.common import removed, shared_folder, short_scans, written

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS, LEAST_REVISIT_BYTES = 16_384, 4_096, 5_000, 0
CRLF = b"\r\n"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page: int | None, digest: str, row: int | None = None, segment: int = 1) -> str:
    """The identifier of a record; `row` tells apart the records of rows that agree in id and payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'page/{page}/{digest}/{row}/{segment}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing: each chunk after its length in hex, then an empty one."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The payload of chunked framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2:
            return None
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it; the text writer adds those."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block


def records(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, row: int | None, chosen_alone: bool, segment_bytes: int) -> list[bytes]:
    """The records of one row. A revisit names the response's record unless several rows are that response; then it names the page alone."""
    named = [("X-Page-ID", page)] if page is not None else []
    common = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Date", "2024-01-01T00:00:00Z"), *named]
    content = ("Content-Type", "application/http;msgtype=response")
    own = record_id(page, digest, row)
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        origin = [("WARC-Refers-To", record_id(refers_to, digest))] if chosen_alone else []
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, content, profile, ("WARC-Payload-Digest", f"sha1:{digest}"), *origin, ("X-Refers-To-Page", refers_to)], head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, content, ("WARC-Payload-Digest", f"sha1:{digest}")]
    out = [record(first + ([("WARC-Segment-Number", 1)] if len(parts) > 1 else []), parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, digest, row, k)), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), *total], part))
    return out


def base32(hexed: Column) -> Column:
    """Base32 of 20 bytes given as hex: each five bytes are 40 bits, eight letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(4):
        value = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("bigint")
        parts += [F.substring(F.lit(letters), (F.shiftright(value, 35 - 5 * i).bitwiseAND(F.lit(31).cast("bigint")) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*parts)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of all pages in `folder`."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    hashed = rows.withColumn("digest", F.sha1("payload"))
    # Only pages that share their payload, and rows that repeat another, move on; a group is one row whatever its size.
    pages_of = hashed.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    latest = F.max_by(F.struct("page_id", (F.col("n") == 1).alias("alone")), "page_id")
    shared = pages_of.filter(F.col("size") >= least_bytes).groupBy("digest").agg(latest.alias("chosen"), F.count("*").alias("pages")).filter("pages > 1").select("digest", "chosen")
    facts = pages_of.join(shared, "digest", "left").filter("n > 1 OR page_id < chosen.page_id").select("digest", "page_id", F.col("n") > 1, F.when(F.col("page_id") < F.col("chosen.page_id"), F.col("chosen")))
    facts = facts.toDF("digest", "page_id", "repeated", "chosen")
    planned = hashed.join(facts, ["digest", "page_id"], "left").select(
        "page_id", "url", "payload", base32(F.col("digest")).alias("digest"), F.col("chosen.page_id").alias("refers_to"),
        F.when(F.coalesce("repeated", F.col("page_id").isNull()), F.monotonically_increasing_id()).alias("row"), F.coalesce("chosen.alone", F.lit(True)).alias("alone"),
    )

    def run(batches):
        for batch in batches:
            out = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in records(*row, segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = planned.mapInArrow(run, "value binary")
    with short_scans(pages.sparkSession):
        lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


class Parser:
    """Records from the CRLF-separated pieces of one file, in order."""

    def __init__(self):
        self.headers: dict[str, str] | None = None
        self.block: list[bytes] = []
        self.left = 0
        self.inside = False

    def take(self, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        """Adds a piece; gives a record when that completes it."""
        if self.inside:
            self.block.append(piece)
            self.left -= len(piece) + 2
            return self.done() if self.left <= -2 else None
        if self.headers is None:
            if piece.startswith(b"WARC/"):
                self.headers = {}
            return None
        if piece:
            name, _, value = piece.decode("utf-8", "replace").partition(":")
            self.headers[name.strip().lower()] = value.strip()
            return None
        self.left, self.block, self.inside = int(self.headers.get("content-length", 0)), [], True
        return self.done() if self.left == 0 else None

    def done(self) -> tuple[dict[str, str], bytes]:
        out = self.headers or {}, CRLF.join(self.block)
        self.headers, self.inside = None, False
        return out


def opened(kind: str | None, block: bytes) -> tuple[bytes, bytes | None]:
    """The HTTP head of a response's whole block and its payload; other blocks, and those of broken framing, as they are and None."""
    head, end, body = block.partition(CRLF + CRLF)
    payload = None if kind != "response" else dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    return (block if payload is None else head + end), payload


RECORD = "type string, record_id string, page_id bigint, origin string, segment int, total bigint, refers_to bigint, payload_digest string, block binary, payload binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in a folder: those of whole responses opened into head (`block`) and payload, others with their block.

    Whole responses are decoded by the task that parses them, so that their bytes pass one Python worker, not two at a time.
    """
    pieces = spark.read.option("lineSep", "\r\n").text(folder).select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("value"))
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        file, parser = None, Parser()
        number = lambda h, k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
        for batch in batches:
            out = []
            files = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for lo, hi in itertools.pairwise(cuts):
                if hi > lo and files[lo] != file:
                    file, parser = files[lo], Parser()
                for piece in batch.column(1).slice(lo, hi - lo).to_pylist():
                    if got := parser.take(piece or b""):
                        h, block = got
                        own = h.get("warc-record-id")
                        out.append((h.get("warc-type"), own, number(h, "x-page-id"), h.get("warc-segment-origin-id") or own, segment := number(h, "warc-segment-number") or 0, number(h, "warc-segment-total-length"), number(h, "x-refers-to-page"), h.get("warc-payload-digest", "").removeprefix("sha1:"), *((block, None) if segment else opened(h.get("warc-type"), block))))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return pieces.mapInArrow(run, RECORD)


def reassembled(read: DataFrame) -> DataFrame:
    """page_id, type, refers_to, payload_digest, payload and complete of every response and revisit record.

    Unsegmented records stay where they are; only segments are grouped, a group being one record's block.
    """
    whole = read.filter("segment = 0 AND type IN ('response', 'revisit')").select("page_id", "type", "refers_to", "payload_digest", "payload", F.lit(True).alias("complete"))
    names = whole.columns
    part = F.struct("segment", "block", "total", "page_id", "type", "payload_digest")
    groups = read.filter("segment > 0").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    block = F.expr("unhex(array_join(transform(parts.block, b -> hex(b)), ''))")
    joined = groups.select(
        F.element_at("parts.page_id", 1).alias("page_id"), F.element_at("parts.type", 1).alias("type"), F.lit(None).cast("bigint").alias("refers_to"),
        F.element_at("parts.payload_digest", 1).alias("payload_digest"), block.alias("block"), F.element_at("parts.total", -1).alias("total"), (F.element_at("parts.segment", -1) == F.size("parts")).alias("all"),
    ).select("page_id", "type", "refers_to", "payload_digest", "block", (F.col("all") & (F.octet_length("block") == F.coalesce("total", F.lit(-1)))).alias("complete"))

    def run(batches):
        for batch in batches:
            payloads = [opened(kind, block or b"")[1] for kind, block in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payloads, pa.binary()), batch.column(5)], names=names)

    decoded = joined.filter("type IN ('response', 'revisit')").mapInArrow(run, "page_id bigint, type string, refers_to bigint, payload_digest string, payload binary, complete boolean")
    return whole.unionByName(decoded)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes archives of the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, complete.

    Size and digest of a response are those of the payload that was put together; a revisit's size is that of the response it names.
    Archives in a given `folder` stay there; without one they are deleted once they have been read.
    """
    spark = pages.sparkSession
    own = folder is None
    folder = shared_folder(spark, "warc") if own else folder
    write(pages, folder, **options)
    back = reassembled(read_records(spark, folder)).select(
        "page_id", F.col("type").alias("record_type"), "refers_to", F.when(F.col("type") == "response", base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), "complete"
    )
    back = written(back)  # ids, sizes and digests only; each use below would read the archives again
    if own:
        removed(spark, folder)
    responses = back.filter("record_type = 'response'")
    # An id may have several payloads: a revisit's size is that of the response with its id and its digest.
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("bytes"))
    revisits = back.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left").withColumnRenamed("bytes", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    return responses.select(columns).unionByName(revisits.select(columns))
