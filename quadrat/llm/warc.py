"""WARC archives: writing, segment reassembly and reading (operator 1).

A page becomes a response record whose block is an HTTP response with a chunked
body. A block longer than ``SEGMENT`` bytes is written as a first segment and
continuation records that name the first one's id; the last carries the total
length. Of equal payloads of at least ``REVISIT_BYTES`` bytes only the one with
the smallest page id is written, the others are revisit records.

Spark's text sink writes the records (a record's closing blank lines are the
sink's line separator), gzipped, at most ``FILE_RECORDS`` to a file, so a file
is bounded and any file system and the usual commit protocol work. Reading
parses whole files, gathers segments by origin id, orders them by number, checks
that none is missing and that their lengths add up to the total, then takes the
chunked framing off and checks the payload digest.

Defined results: a null page is an empty payload; a null url is an empty one,
control characters and spaces in urls are percent-encoded; a null page id keeps
its record and sorts after all others; repeated page ids keep a record each; of
equal rows one is the response; an empty table gives empty archives and an empty
result; other columns are ignored. A record that is damaged raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, ship, stored

SEGMENT = 16 << 10
CHUNK = 4 << 10
REVISIT_BYTES = 100
FILE_RECORDS = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for a in range(0, len(payload), size):
        x = payload[a:a + size]
        parts += [b"%x\r\n" % len(x), x, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body (chunk extensions and trailers are allowed)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            break
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at:at + size])
        at += size + 2
    return b"".join(out)


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP header is cut off")
    chunks = any(h.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for h in head.split(b"\r\n")[1:])
    return unchunked(body) if chunks else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its closing blank lines."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def page_records(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page."""
    uri = _BAD.sub(lambda m: f"%{ord(m.group()):02X}", url or "")
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("Page-ID", page_id),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Profile", PROFILE),
                      ("WARC-Refers-To", f"<{refers_to}>"), *common], HTTP)
        return
    block = HTTP + chunked(payload)
    kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>")]
    if len(block) <= segment:
        yield record([*kind, *common], block)
        return
    last = -(-len(block) // segment)
    yield record([*kind, ("WARC-Segment-Number", 1), *common], block[:segment])
    for k in range(2, last + 1):
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{k}>"),
                      ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<{name}>"),
                      ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == last else None)],
                     block[(k - 1) * segment:k * segment])


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in raw[at:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = raw[end + 4:end + 4 + size]
        at = end + 4 + size
        if len(block) < size or raw[at:at + 4] != b"\r\n\r\n":
            raise ValueError("record is cut off")
        at += 4
        yield fields, block


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write the archives of ``pages`` (page_id, url, html) under ``path``."""
    ship(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        F.monotonically_increasing_id().alias("row")).withColumn("digest", F.sha2("html", 256))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    # Only payloads that occur again are joined; the minimum is pre-aggregated.
    again = (base.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
             .select("digest", "first"))
    known = base.join(again, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for page, url, html, row, digest, origin in zip(*(c.to_pylist() for c in b.columns)):
                name = f"urn:page:{row}"
                refers = f"urn:page:{origin}" if origin is not None and origin != row else None
                for r in page_records(name, page, url, html.encode(), digest, refers, segment):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = known.select("page_id", "url", "html", "row", "digest", F.col("first.row").alias("origin"))
    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


FIELDS = ("record_id string, record_type string, page_id long, url string, refers_to_id string, "
          "declared_digest string, segment int, total long, block binary")
_KIND = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                   ("url", pa.string()), ("refers_to_id", pa.string()), ("declared_digest", pa.string()),
                   ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _parser(segmented: bool):
    """Rows of the records that are segments, or of all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                rows = []
                for f, block in parse(zlib.decompress(cell.as_py(), 47)):
                    if ("warc-segment-number" in f) != segmented:
                        continue
                    rows.append({
                        "record_id": f.get("warc-segment-origin-id", f["warc-record-id"]), "record_type": f["warc-type"],
                        "page_id": int(f["page-id"]) if "page-id" in f else None, "url": f.get("warc-target-uri"),
                        "refers_to_id": f.get("warc-refers-to"), "declared_digest": f.get("warc-payload-digest"),
                        "segment": int(f.get("warc-segment-number", 1)),
                        "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        "block": block})
                yield pa.RecordBatch.from_pylist(rows, _KIND)
    return run


def _check_segments(numbers: list[int], blocks: list[bytes], total: int | None) -> bytes:
    """The whole block of a segmented record."""
    if numbers != list(range(1, len(numbers) + 1)):
        raise ValueError(f"segments {numbers[:20]} are not 1 to {len(numbers)}")
    block = b"".join(blocks)
    if total is None or len(block) != total:
        raise ValueError(f"segments have {len(block)} bytes, the record {total}")
    return block


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        payload = []
        for kind, numbers, blocks, total, declared in zip(
                cols["record_type"], cols["numbers"], cols["blocks"], cols["total"], cols["declared_digest"]):
            block = blocks[0] if numbers is None else _check_segments(numbers, blocks, total)
            body = http_payload(block) if kind == "response" else None
            if body is not None and declared and declared != f"sha256:{hashlib.sha256(body).hexdigest()}":
                raise ValueError("payload digest differs")
            payload.append(body)
        keep = ["record_id", "record_type", "page_id", "url", "refers_to_id", "declared_digest"]
        yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keep],
                                          pa.array(payload, pa.binary())], [*keep, "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``: record_id, record_type,
    page_id, url, refers_to_id, declared_digest, payload (null for revisits)."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    one = files.mapInArrow(_parser(False), FIELDS).select(
        "record_id", "record_type", "page_id", "url", "refers_to_id", "declared_digest",
        F.lit(None).cast("array<int>").alias("numbers"), F.array("block").alias("blocks"), "total")
    # The segments of one record, never more than one page's.
    many = (files.mapInArrow(_parser(True), FIELDS).groupBy("record_id")
            .agg(F.max("page_id").alias("page_id"), F.max("url").alias("url"),
                 F.max("declared_digest").alias("declared_digest"), F.max("total").alias("total"),
                 F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"))
            .select("record_id", F.lit("response").alias("record_type"), "page_id", "url",
                    F.lit(None).cast("string").alias("refers_to_id"), "declared_digest",
                    F.col("s.segment").alias("numbers"), F.col("s.block").alias("blocks"), "total"))
    return one.union(many).mapInArrow(
        _payloads, "record_id string, record_type string, page_id long, url string, refers_to_id string, "
                   "declared_digest string, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page:
    revisits take theirs from the record they refer to."""
    slim = stored(records.select("record_id", "record_type", "page_id", "refers_to_id", "declared_digest",
                                 F.octet_length("payload").cast("long").alias("payload_bytes"),
                                 F.sha2("payload", 256).alias("payload_digest")), "records")
    response = slim.where(F.col("record_type") == "response")
    origin = response.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
                             F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    revisit = (slim.where(F.col("record_type") == "revisit").select("page_id", "refers_to_id", "declared_digest")
               .join(origin, "refers_to_id", "left"))
    ok = F.col("declared_digest") == F.concat(F.lit("sha256:"), F.col("d"))
    revisit = revisit.withColumn("d", F.when(ok, F.col("d")).otherwise(
        F.raise_error(F.lit("a revisit refers to no record with its payload"))))
    return (response.select("page_id", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("long").alias("refers_to"))
            .union(revisit.select("page_id", F.col("b"), F.col("d"), F.lit("revisit"), "refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to a new shared folder, read them back and resolve."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return resolve(read_archives(spark, path))
