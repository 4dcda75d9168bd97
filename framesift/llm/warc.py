"""Web archives: pages written as WARC records in segments, and read back whole.

Records are rows of bytes that Spark's text writer puts into gzip files with
the two line ends that close a record, so any store Spark reaches will do.
Long records are cut into a first segment and continuations; readers group
these by the record they began as, put them in order, check what is there
against the length the last one tells, and undo the chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.batches import pieces

END = b"\r\n"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """Blocks over ``segment`` bytes are continued; bodies are framed in chunks
    of ``chunk`` bytes; a file has at most ``records`` records, so that no
    file is more than their product; payloads of ``least`` bytes or more are
    kept once."""

    segment: int = 16384
    chunk: int = 4096
    records: int = 1000
    least: int = 0
    date: str = "2025-01-01T00:00:00Z"


FIELDS = ["record_id", "page_id", "record_type", "refers_to_id", "digest", "origin", "segment", "total", "block"]
RECORDS = ("record_id string, page_id long, record_type string, refers_to_id string, digest string, "
           "origin string, segment long, total long, block binary")


def written(pages: DataFrame, path: str, archive: Archive = Archive(), page_id: str = "page_id", url: str = "url",
            html: str = "html") -> None:
    """Write a record per page to gzip files under ``path``.

    Of pages with equal payloads the one with the largest ``page_id`` is a
    response and the others revisit it (those without an id count as
    smallest; rows that repeat the largest id are all responses). A null html
    is an empty payload. Other columns are left out whatever they're called.
    Record ids use rows' places, so pages have to be read from a table.

    Digests are grouped without the payloads, combined before the shuffle, and
    only digests that repeat come back, so a payload that a third of all
    pages share costs one row; the join that brings it back is an equi-join
    that adaptive execution splits.
    """
    given = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    given = given.withColumn("sha1", F.sha1("payload"))
    kept = (
        given.where(F.octet_length("payload") >= archive.least).groupBy(F.col("sha1").alias("_sha1"))
        .agg(F.max(F.struct("page_id", "row")).alias("kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    joined = given.join(kept, F.col("sha1") == F.col("_sha1"), "left").select(
        "row", "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("kept.page_id")) & F.col("kept").isNotNull(), F.col("kept.page_id"))
        .alias("of_page"),
        F.when(~F.col("page_id").eqNullSafe(F.col("kept.page_id")), F.col("kept.row")).alias("of_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "payload"):
            records = [r for row in piece.to_pylist() for r in page_records(row, archive)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    records = joined.mapInArrow(run, "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("compression", "gzip").option("maxRecordsPerFile", archive.records).text(path))


def name(page: int | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{row}>"


def page_records(row: dict, archive: Archive) -> list[bytes]:
    """A page's record, or its segments, each without the line ends after it."""
    payload, own = row["payload"], name(row["page_id"], row["row"])
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisits = row["of_row"] is not None
    block = HTTP if revisits else HTTP + b"".join(framed(payload, archive.chunk))
    head = {"WARC-Date": archive.date}
    if row["url"] is not None:
        head["WARC-Target-URI"] = row["url"].replace("\r", "%0D").replace("\n", "%0A")
    if row["page_id"] is not None:
        head["Page-Id"] = row["page_id"]
    first = {"WARC-Type": "revisit" if revisits else "response", "WARC-Record-ID": own,
             "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if revisits:
        first |= {"WARC-Refers-To": name(row["of_page"], row["of_row"]), "WARC-Profile": PROFILE}
    parts = [block[k : k + archive.segment] for k in range(0, len(block), archive.segment)]
    if len(parts) == 1:
        return [record(head | first, block)]
    found = [record(head | first | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{k}>", "WARC-Segment-Origin-ID": own,
                "WARC-Segment-Number": k}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        found.append(record(head | more, part))
    return found


def framed(payload: bytes, size: int) -> Iterator[bytes]:
    for k in range(0, len(payload), size):
        chunk = payload[k : k + size]
        yield b"%x\r\n%b\r\n" % (len(chunk), chunk)
    yield b"0\r\n\r\n"


def record(head: dict, block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def unframed(body: bytes) -> bytes:
    """A body without its chunked framing; ValueError if that's broken."""
    found, at = [], 0
    while True:
        line = body.index(END, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(found)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk is shorter or longer than it says")
        found.append(body[at : at + size])
        at += size + 2


def file_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record's fields, by lower-case name, and its block."""
    at = 0
    while at < len(data):
        end = data.index(END + END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        at += 4


def records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The archive's records as rows: those in segments, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f, pa.int64() if f in ("page_id", "segment", "total") else
                            pa.binary() if f == "block" else pa.string()) for f in FIELDS])
        for piece in pieces(batches, "content", 1):
            rows = []
            for data in piece.column("content").to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for fields, block in file_records(data):
                    number = fields.get("warc-segment-number")
                    if (number is not None) != segmented or fields["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    page, total = fields.get("page-id"), fields.get("warc-segment-total-length")
                    own = fields["warc-record-id"]
                    rows.append((
                        own, None if page is None else int(page), fields["warc-type"], fields.get("warc-refers-to"),
                        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        fields.get("warc-segment-origin-id", own), int(number or 1), None if total is None else int(total), block))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)] if rows else
                                             [pa.array([], k.type) for k in kinds], schema=kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_id, record_type, refers_to_id, payload, payload_bytes,
    payload_digest, problem`` of each record in the archives under ``path``.

    Segments are grouped by the record they began as; a record's are no more
    than one payload. Payload and length of revisits are null here (see
    ``resolved``); their digest is the one written. A record whose segments
    are missing, don't add up or whose framing or digest is wrong keeps its
    row, with ``problem`` saying so and no payload.
    """
    part = F.struct("segment", "total", "block")
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
             for c in ("page_id", "record_type", "refers_to_id", "digest")]
    whole = records(spark, path, False).select(
        F.col("record_id").alias("origin"), "page_id", "record_type", "refers_to_id", "digest", F.array(part).alias("parts"))
    joined = records(spark, path, True).groupBy("origin").agg(*first, F.array_sort(F.collect_list(part)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                rows = [payload(r["parts"], r["record_type"], r["digest"]) for r in piece.select(
                    ["parts", "record_type", "digest"]).to_pylist()]
                found = [pa.array([r[k] for r in rows], t) for k, t in
                         enumerate((pa.binary(), pa.int64(), pa.string(), pa.string()))]
                kept = [piece.column(c) for c in ("page_id", "origin", "record_type", "refers_to_id")]
                yield pa.RecordBatch.from_arrays([*kept, *found], NAMES)

    return whole.unionByName(joined.select(whole.columns)).mapInArrow(
        run, "page_id long, record_id string, record_type string, refers_to_id string, payload binary, "
             "payload_bytes long, payload_digest string, problem string")


NAMES = ["page_id", "record_id", "record_type", "refers_to_id", "payload", "payload_bytes", "payload_digest", "problem"]


def payload(parts: list[dict], kind: str, digest: str | None) -> tuple[bytes | None, int | None, str | None, str | None]:
    block = b"".join(p["block"] for p in parts)
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or kind is None:
        return None, None, digest, "segments are missing or repeated"
    if len(parts) > 1 and parts[-1]["total"] != len(block) or len(parts) == 1 and parts[0]["total"] not in (None, len(block)):
        return None, None, digest, "segments don't add up to the length told"
    if kind == "revisit":
        return None, None, digest, None
    head, _, body = block.partition(END + END)
    try:
        found = unframed(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as why:
        return None, None, digest, str(why)
    own = base64.b32encode(hashlib.sha1(found).digest()).decode()
    if digest is not None and digest != own:
        return None, None, digest, "the payload isn't what its digest says"
    return found, len(found), own, None


def resolved(found: DataFrame) -> DataFrame:
    """Rows of ``read`` (without payloads, from a table) with ``refers_to``, the
    page revisited, and a revisit's length from the record it refers to."""
    known = found.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"))
    return found.join(known, (F.col("refers_to_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("_page").alias("refers_to"), "problem")
