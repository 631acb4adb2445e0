"""WARC archives (operator 5): write pages as records, read archives back, reassemble segments.

Writing: records of equal payload refer to the first of them; long blocks are cut into a first
segment and continuation records; payloads are framed with the chunked transfer coding. Spark's
text sink writes each record as it is, followed by the two line ends the format asks for, so any
store that Spark reaches will do.

Reading: the text source cuts the stream at each version line. The line repeats no part of its own
beginning, so a reader that starts anew at the next byte after a partial match misses none, also
where a buffer ends within it. The writer never leaves a version line inside a block or a header;
a foreign archive that has one gives records whose length does not fit, and these are marked
``complete = false``, not dropped.
Continuation records are grouped by origin identifier, ordered by segment number, checked against
the total length and joined; then the chunked framing is taken off and the digest compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.llm.common import prepare, small, stage

VERSION = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
CHUNK = 8192


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(data: bytes, begin: int, end: int) -> int:
    """``end``, or two bytes less when the piece ends with the version: a line end follows each
    piece and would make it a version line."""
    return end - 2 if data[max(begin, end - len(VERSION) + 2) : end] == VERSION[:-2] else end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding; a version line of the payload is broken by a chunk border."""
    out, begin = [], 0
    line = payload.find(VERSION)
    while begin < len(payload):
        if 0 <= line < begin:
            line = payload.find(VERSION, begin)
        end = min(begin + size, len(payload), line + 2 if line >= 0 else len(payload))
        end = _cut(payload, begin, end)
        out.append(b"%x\r\n%b\r\n" % (end - begin, payload[begin:end]))
        begin = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def segments(block: bytes, size: int) -> list[bytes]:
    """The block in pieces of about ``size`` bytes."""
    out, begin = [], 0
    while begin < len(block):
        end = _cut(block, begin, min(begin + size, len(block)))
        out.append(block[begin:end])
        begin = end
    return out


def unchunk(body: bytes) -> bytes | None:
    """Payload of a chunked body; None when the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        part = body[at : at + size]
        if len(part) < size or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(part)
        at += size + 2


def record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%b: %b\r\n" % f for f in [(b"WARC-Type", kind), *fields, (b"Content-Length", b"%d" % len(block))])
    return VERSION + head + b"\r\n" + block


def _clean(value: str | None) -> bytes:
    """A header value: control characters are percent-encoded, and the last one of a value that
    would end its line like a version line."""
    out = b"".join(b"%%%02X" % c if c < 32 or c == 127 else bytes([c]) for c in (value or "").encode())
    return out[:-1] + b"%%%02X" % out[-1] if out.endswith(VERSION[:-2]) else out


def page_records(row_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: bytes, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a whole response, or a response with continuations."""
    me = b"<urn:row:%b>" % row_id.encode()
    shared = [(b"WARC-Date", date), (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode())]
    if uri is not None:
        shared.append((b"WARC-Target-URI", _clean(uri)))
    if refers_to is not None:
        yield record(b"revisit", [(b"WARC-Record-ID", me), *shared, (b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", b"<urn:row:%b>" % refers_to.encode())], b"")
        return
    block = HTTP_HEAD + chunked(payload)
    kind = (b"Content-Type", b"application/http;msgtype=response")
    parts = segments(block, segment_bytes)
    if len(parts) == 1:
        yield record(b"response", [(b"WARC-Record-ID", me), *shared, kind], block)
        return
    yield record(b"response", [(b"WARC-Record-ID", me), *shared, kind, (b"WARC-Segment-Number", b"1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        fields = [(b"WARC-Record-ID", b"<urn:row:%b:%d>" % (row_id.encode(), k)), (b"WARC-Date", date), (b"WARC-Segment-Origin-ID", me), (b"WARC-Segment-Number", b"%d" % k)]
        if k == len(parts):
            fields.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield record(b"continuation", fields, part)


def _writer(date: bytes, segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row_id, uri, payload, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for r in page_records(row_id, uri, payload, refers, date, segment_bytes):
                    out.append(r)
                    size += len(r)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return write


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, segment_bytes: int = 16384, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip",
) -> None:
    """Write one response or revisit record (and its continuations) per row of ``pages``.

    ``pages`` must read the same twice (files or a staged table): payloads are first hashed and
    grouped, then written. A null payload is empty, a null uri leaves its field out. Of equal
    payloads of at least ``min_revisit_bytes``, the row with the smallest id (null last; of rows
    that repeat an id, the first) is the response and the others are revisits of it. An empty
    table writes an archive without records.
    """
    if segment_bytes < 2 * len(VERSION):
        raise ValueError(f"segments of {segment_bytes} bytes are too short")
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("pos"),
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "pos")
    long_enough = F.length("payload") >= min_revisit_bytes
    groups = rows.filter(long_enough).select("key", order.alias("order")).groupBy("key").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"))
    several = stage(groups.filter("n > 1").select("key", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")), "warc-several")
    out = rows.join(small(several, 64), "key", "left")
    name = _row_name(F.col("id"), F.col("pos"))
    other = F.col("first_pos").isNotNull() & (F.col("first_pos") != F.col("pos")) & long_enough
    out = out.select(name, "uri", "payload", F.when(other, _row_name(F.col("first_id"), F.col("first_pos"))))
    records = out.mapInArrow(_writer(date.encode(), segment_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


def _row_name(row_id: Column, pos: Column) -> Column:
    """Names a row in record identifiers: its id (empty for null) and its place."""
    return F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), pos.cast("string"))


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")
_RAW = "kind string, record_id string, uri string, digest string, refers_to string, origin string, number long, total long, complete boolean, block binary"
RECORDS = "record_id string, kind string, uri string, refers_to string, header_digest string, segments int, complete boolean, payload binary, payload_digest string"


def parse_record(piece: bytes) -> tuple | None:
    """One record (without its version line) as the columns of _RAW; None for no record."""
    head, _, rest = piece.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    if not fields:
        return None
    length = _whole(fields.get("content-length"))
    fits = length is not None and len(rest) >= length and rest[length:] in (b"", b"\r\n\r\n")
    block = rest[:length] if fits else rest
    text = [fields.get(f) for f in _FIELDS]
    return (*text[:6], _whole(text[6]), _whole(text[7]), fits, block)


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in _RAW.split(", ")]
    for batch in batches:
        rows = [r for r in map(parse_record, batch.column(0).to_pylist()) if r]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def decode_block(block: bytes) -> bytes | None:
    """Payload of an HTTP response block: the head is taken off, chunked framing removed."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not blank:
        return block
    codings = [v.strip().lower() for n, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]) if n.strip().lower() == b"transfer-encoding"]
    return unchunk(body) if any(c.endswith(b"chunked") for c in codings) else body


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts (list of number, total, complete and block, in order) to decoded records."""
    kinds = [pa.string()] * 5 + [pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            parts = sorted(r["parts"], key=lambda p: p["number"])
            first = next((p for p in parts if p["kind"] != "continuation"), None)
            block = b"".join(p["block"] for p in parts)
            numbered = [p["number"] for p in parts] == list(range(1, len(parts) + 1))
            total = parts[-1]["total"]
            whole = numbered and first is not None and all(p["complete"] for p in parts) and (len(parts) == 1 or total == len(block))
            head = first or {}
            payload = decode_block(block) if head.get("kind") != "revisit" else b""
            digest = base32_sha1(payload) if payload is not None and head.get("kind") != "revisit" else None
            said = (head.get("digest") or "").rpartition(":")[2] or None
            whole = whole and payload is not None and (digest is None or said is None or said == digest)
            out.append((r["record_id"], head.get("kind"), head.get("uri"), head.get("refers_to"), said, len(parts), whole, payload, digest))
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives at ``path``, segments joined: record_id, kind, uri, refers_to,
    header_digest, segments, complete, payload, payload_digest.

    ``complete`` is false when a length does not fit, a segment or the origin is missing, the
    framing is broken or the digest differs; the payload is then what could be read (null when
    the framing is broken). Only segmented records are shuffled, by origin.
    """
    prepare(spark)
    pieces = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary"))
    parsed = pieces.mapInArrow(_parse, _RAW)
    part = F.struct("kind", "uri", "digest", "refers_to", F.coalesce("number", F.lit(1)).alias("number"), "total", "complete", "block")
    alone = parsed.filter("number is null and origin is null").select("record_id", F.array(part).alias("parts"))
    cut = parsed.filter("number is not null or origin is not null")
    cut = cut.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(F.collect_list(part).alias("parts"))
    return alone.unionByName(cut).mapInArrow(_assemble, RECORDS)


def page_report(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, complete per archived page;
    a revisit takes its length and digest from the response it refers to."""
    rows = stage(
        records.select("record_id", "kind", "refers_to", "header_digest", "complete", F.length("payload").cast("bigint").alias("bytes"), "payload_digest"),
        "warc-records",
    )
    answers = rows.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("bytes").alias("there"), F.col("payload_digest").alias("there_digest"), F.col("complete").alias("there_complete")
    )
    asked = rows.filter("kind = 'revisit'").select("refers_to").distinct()
    answers = answers.join(asked, "refers_to", "left_semi")
    revisits = rows.filter("kind = 'revisit'").join(answers, "refers_to", "left")
    page = lambda c: F.regexp_extract(c, "^<urn:row:(.*):[0-9]+>$", 1)
    key = lambda c: F.when(page(c) != "", page(c)).cast(id_type)
    same = F.coalesce(F.col("there_complete") & (F.col("there_digest") == F.col("header_digest")), F.lit(False))
    return (
        rows.filter("kind = 'response'")
        .select(key("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"), "complete")
        .unionByName(revisits.select(
            key("record_id").alias("page_id"), F.col("there").alias("payload_bytes"), F.col("there_digest").alias("payload_digest"), F.col("kind").alias("record_type"),
            key("refers_to").alias("refers_to"), same.alias("complete"),
        ))
    )
