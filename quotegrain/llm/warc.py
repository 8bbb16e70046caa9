"""WARC archives: records with chunked transfer framing, long ones in segments, written by Spark's text sink and read back.

A record is one row of bytes, and Spark's text sink writes a row's bytes as they are, followed by a separator; the
last line feed of each record is that separator. So archives are plain ``.warc`` content, in gzip files, on any file
system Spark writes to. Reading takes files (``binaryFile``; also with a gzip member for each record), unpacks them as
records are cut off by Content-Length, and reassembles segments: rows of continuation records are grouped by origin identifier, ordered by segment number, checked against the total length,
and the chunked framing of the whole is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import parts_for, scratch_dir, shuffle_parts, text_bytes, written

SEGMENT_BYTES = 16384
CHUNK = 8192
FILE_BYTES = 16 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

PARSED_SCHEMA = (
    "record_id string, origin_id string, segment int, total_length long, record_type string, target_uri string, "
    "payload_digest string, refers_to string, payload_length long, block binary"
)
RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary, complete boolean"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + n]
        if len(piece) < n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(piece)
        at = end + 4 + n


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r"  # the sink adds the last line feed


def _one_line(text: str) -> str:
    return "".join(c if c not in "\r\n" else " " for c in text)


def _name(page_id: int | None, digest: str, marked: bool | None, repeat: int = 1) -> str:
    """The identifier of the ``repeat``-th row of a page_id and html; the page_id is its last part."""
    if repeat == 1 and not marked and page_id is not None:
        return f"urn:x-page:{page_id}"
    return f"urn:x-page:{digest}-{repeat}:{page_id}"


def _records_of(name: str, url: str | None, html: str | None, first: str | None, segment_bytes: int) -> list[bytes]:
    """``first``: the record that this one revisits."""
    payload = (html or "").encode()
    fields = [
        ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _one_line(url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
    ]
    if first is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Refers-To", f"<{first}>"), ("X-Payload-Length", str(len(payload)))]
        return [_record([*more, *fields, ("Content-Type", "application/http; msgtype=response")], _HTTP)]
    block = _HTTP + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *fields, kind], block)]
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), *fields, kind, ("WARC-Segment-Number", "1")], pieces[0])]
    for i, piece in enumerate(pieces[1:], 2):
        more = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:segment:{i}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(i)),
        ]
        out.append(_record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (i == len(pieces)), piece))
    return out


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = 0) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) below ``path``; see ``_records_of`` for their form.

    Rows with equal payloads of at least ``min_revisit_bytes`` bytes: that with the smallest page_id is a response, the
    others revisit it. A null html or url is empty; a null page_id is written as ``None`` and is always a response.
    Repeated rows are written each time. An empty table writes no record. Other columns are ignored.
    Only digests are grouped; payloads are shuffled once, by page_id and digest.

    Every record has an identifier of its own: urn:x-page:{page_id}, and with the html's digest and a number before the
    page_id for null ids, further rows of a page_id and html, and all but the least digest of a page_id.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    all_keys = rows.where("page_id is not null").select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    keys = all_keys.where(F.col("n") >= min_revisit_bytes)
    firsts = keys.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    roles = keys.join(firsts, ["digest", "n"]).where("first <> page_id").select("page_id", "digest", "first").distinct()
    # page_ids with several payloads: all but the least digest are marked
    several = all_keys.groupBy("page_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most").drop("most")
    marks = all_keys.join(several, "page_id").where("digest > least").select("page_id", "digest").distinct()
    marks = written(marks.withColumn("marked", F.lit(True)), "marks")
    roles = roles.join(marks.select(F.col("page_id").alias("first"), "digest", F.col("marked").alias("first_marked")), ["first", "digest"], "left")
    roles = roles.join(marks, ["page_id", "digest"], "full")
    total = text_bytes(rows, "html")
    n = parts_for(total, FILE_BYTES, shuffle_parts(spark))
    by = ["page_id", "digest"]
    dealt = rows.withColumn("digest", F.sha2(html, 256)).repartition(n, *by).join(roles.repartition(n, *by).hint("merge"), by, "left")
    # rows of one page_id and html are in one partition, and one after another there
    dealt = dealt.sortWithinPartitions(*by).select("page_id", "digest", "marked", "first", "first_marked", "url", "html")

    def records(batches):
        last, repeat = None, 0
        for batch in batches:
            made, size = [], 0
            for page_id, digest, marked, first, first_marked, url, page in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                last, repeat = (page_id, digest), repeat + 1 if (page_id, digest) == last else 1
                target = None if first is None else _name(first, digest, first_marked)
                for record in _records_of(_name(page_id, digest, marked, repeat), url, page, target, segment_bytes):
                    made.append(record)
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    dealt.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path, compression="gzip")


#: Bytes of a record's fields at most; more are no fields.
_HEAD = 1 << 20


def _parse(content: bytes):
    """Yields the fields and the block of each record of an archive, plain or in gzip members, which is unpacked as it is
    read. Stops at bytes that are no record, and where a gzip stream is damaged: records before that are whole."""
    stream = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        while True:
            line = stream.readline(_HEAD)
            while line in (b"\r\n", b"\n", b"\r"):
                line = stream.readline(_HEAD)
            if not line.startswith(b"WARC/"):
                return
            fields, size = {}, len(line)
            while (line := stream.readline(_HEAD)) not in (b"\r\n", b""):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
                size += len(line)
                if size > _HEAD:
                    return
            n = int(fields.get("content-length") or 0)
            block = stream.read(n)
            if not line or len(block) < n:
                return
            yield fields, block
    except (EOFError, OSError, zlib.error, ValueError):
        return


def _parsed(batches):
    names = ["record_id", "origin_id", "segment", "total_length", "record_type", "target_uri", "payload_digest", "refers_to", "payload_length", "block"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    whole = lambda v: int(v) if v and v.isdigit() else None
    bare = lambda v: v.strip("<>") if v else None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names)

    for batch in batches:
        for content in batch.column(0):
            rows, size, raw = [], 0, content.as_py() or b""
            for f, block in _parse(raw):
                digest = (f.get("warc-payload-digest") or "").rpartition(":")[2] or None
                rows.append((bare(f.get("warc-record-id")), bare(f.get("warc-segment-origin-id")), whole(f.get("warc-segment-number")), whole(f.get("warc-segment-total-length")), f.get("warc-type"), f.get("warc-target-uri"), digest, bare(f.get("warc-refers-to")), whole(f.get("x-payload-length")), block))
                size += len(block)
                if size > 8 << 20:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)


def _assembled(batches):
    """Rows of the blocks of a record, in order, become records: HTTP header cut off, chunked framing decoded, digest compared."""
    names = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload", "complete"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            block = b"".join(r.pop("blocks"))
            head, _, body = block.partition(b"\r\n\r\n")
            whole = r["total_length"] is None or r["total_length"] == len(block)
            if r["record_type"] == "revisit":
                rows.append((r["record_id"], "revisit", r["target_uri"], r["payload_digest"], r["refers_to"], r["payload_length"], None, True))
                continue
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            good = whole and payload is not None
            digest = sha1_base32(payload) if good else None
            rows.append((r["record_id"], r["record_type"], r["target_uri"], digest, None, len(payload) if good else None, payload if good else None, good and r["payload_digest"] in (None, digest)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``, segments reassembled.

    ``complete`` is false where a segment is missing or repeated, the total length differs, the framing is broken or
    the digest does not fit; the payload and its length are null there unless only the digest differs. The digest of a
    response is computed from the decoded payload; a revisit keeps that of its header and has no payload.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(_parsed, PARSED_SCHEMA)
    single = parsed.where("segment is null and record_type <> 'continuation'")
    parts = parsed.where("segment is not null or record_type = 'continuation'")
    grouped = parts.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total_length"),
        *(F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c) for c in ("record_type", "target_uri", "payload_digest")),
    )
    # the pieces of one record, in order: 1, 2, ... without a gap, else the length can't fit
    in_order = F.forall(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get(F.col("parts"), i - 1)["segment"] == i)
    joined = grouped.where("record_type is not null").select(
        "record_id", "record_type", "target_uri", "payload_digest",
        F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("long").alias("payload_length"),
        F.when(in_order & F.col("total_length").isNotNull(), F.col("total_length")).otherwise(F.lit(-1)).alias("total_length"),
        F.col("parts.block").alias("blocks"),
    )
    single = single.select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_length", "total_length", F.array("block").alias("blocks"))
    return single.unionByName(joined).mapInArrow(_assembled, RECORD_SCHEMA)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``pages`` written as archives in the shared scratch folder and read back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes)
    return read_archives(pages.sparkSession, path)


def page_report(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), of records named ``urn:x-page:``."""
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "complete")
