"""WARC archives: records written in segments, read back and put together again.

A message (HTTP head and chunked body) longer than a segment is cut: its first
part is the ``response`` record, the others are ``continuation`` records that
name the first by WARC-Segment-Origin-ID and count on in WARC-Segment-Number;
the last one also holds WARC-Segment-Total-Length. Reading groups records by
origin, orders the segments, checks that none is missing and that the length is
right, and takes the chunk framing off.

Records are written by Spark's text writer whose line end is the end of a
record, so archives land in any store that Spark can reach. Segments bound the
size of a record, and a bound on records per file bounds the file, which is read
back whole.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import utf8

END = "\r\n\r\n"
FILE_BYTES = 8 << 20
CHUNK_BYTES = 1500
#: Fixed format values of the archive standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
RECORDS = ("record_id string, origin_id string, record_type string, target_uri string, key string, refers_to string, "
           "digest string, segment int, total_length bigint, block binary")


def payload_digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def mark_revisits(df: DataFrame, key: str, payload: str, smallest: int = 100) -> DataFrame:
    """Add ``__digest``, ``__first`` (smallest key with the same payload) and ``__revisit``.

    Payloads below ``smallest`` bytes are never revisits. Rows that share key
    and payload with the first are first as well; a null key comes last.
    """
    body = utf8(payload)
    tagged = df.withColumn("__digest", payload_digest(body)).withColumn("__bytes", F.octet_length(body).cast("bigint"))
    groups = tagged.where(F.col("__bytes") >= smallest).groupBy("__digest").agg(
        F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    joined = tagged.join(groups, "__digest", "left")
    return joined.withColumn("__revisit", F.col("__first").isNotNull() & ~F.col(key).eqNullSafe(F.col("__first")))


def _pieces(data: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes that never cut a character."""
    out, start = [], 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[start:end])
        start = end
    return out or [b""]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in _pieces(payload, size) if p]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The body without chunk framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        part = data[line + 2: line + 2 + size]
        if len(part) < size or data[line + 2 + size: line + 4 + size] != b"\r\n":
            return None
        out.append(part)
        at = line + 4 + size


def _record(fields: list, block: bytes) -> str:
    lines = [f"{name}: {' '.join(str(value).split())}" for name, value in fields if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + END + block.decode("utf-8")


def _records(segment_bytes: int, date: str):
    def one(key, url, payload, digest, first, revisit):
        own = f"<urn:uuid:{uuid.uuid4()}>"
        common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", key)]
        if revisit:
            yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT_PROFILE),
                           ("WARC-Refers-To-Page-ID", first), ("WARC-Payload-Digest", f"sha256:{digest}"),
                           ("Content-Type", "application/http; msgtype=response")], (HEAD + "\r\n").encode())
            return
        message = f"{HEAD}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
        parts = _pieces(message, segment_bytes)
        for number, part in enumerate(parts, 1):
            fields = [("WARC-Type", "response" if number == 1 else "continuation"),
                      ("WARC-Record-ID", own if number == 1 else f"<urn:uuid:{uuid.uuid4()}>"), *common]
            if number == 1:
                fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
            else:
                fields.append(("WARC-Segment-Origin-ID", own))
            if len(parts) > 1:
                fields.append(("WARC-Segment-Number", number))
                if number == len(parts):
                    fields.append(("WARC-Segment-Total-Length", len(message)))
            yield _record(fields, part)

    def run(batches):
        for rows in batches:
            values = []
            for row in rows.itertuples(index=False):
                values.extend(one(row.key, row.url, bytes(row.payload), row.digest, row.first, row.revisit))
                if len(values) >= 2000:
                    yield pd.DataFrame({"value": values})
                    values = []
            if values:
                yield pd.DataFrame({"value": values})

    return run


def write_archives(df: DataFrame, path: str, key: str, url: str, payload: str, segment_bytes: int = 4096,
                   smallest_revisit: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row to gzip-compressed archives under ``path``.

    A payload equal to that of a row with a smaller key becomes a ``revisit``
    record without body. A null payload is empty; null url and key leave out
    their header; repeated rows get a record each; other columns are ignored.
    """
    rows = mark_revisits(df.select(F.col(key).alias("__key"), F.col(url).alias("__url"), utf8(payload).alias("__payload")),
                         "__key", "__payload", smallest_revisit)
    sent = rows.select(
        F.col("__key").cast("string").alias("key"), F.col("__url").cast("string").alias("url"),
        F.when(F.col("__revisit"), F.lit(b"")).otherwise(F.col("__payload")).alias("payload"),
        F.col("__digest").alias("digest"), F.col("__first").cast("string").alias("first"), F.col("__revisit").alias("revisit"))
    per_file = max(1, FILE_BYTES // (segment_bytes + 1024))
    sent.mapInPandas(_records(segment_bytes, date), "value string").write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _parse(data: bytes):
    """Records of one archive; a record that doesn't parse ends it and is given as ``broken``."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        head = data[at:stop].decode("utf-8", "replace").split("\r\n") if stop >= 0 else [""]
        fields = {}
        for line in head[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not head[0].startswith("WARC/") or not length.isdigit() or stop + 4 + int(length) > len(data):
            yield {"warc-type": "broken"}, b""
            return
        yield fields, data[stop + 4: stop + 4 + int(length)]
        at = stop + 8 + int(length)


def _read(batches):
    for files in batches:
        for content in files["content"]:
            data = bytes(content)
            rows = []
            for fields, block in _parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                digest = fields.get("warc-payload-digest", "")
                rows.append((
                    fields.get("warc-record-id"), fields.get("warc-segment-origin-id"), fields.get("warc-type"),
                    fields.get("warc-target-uri"), fields.get("warc-page-id"), fields.get("warc-refers-to-page-id"),
                    digest.rpartition(":")[2].lower() or None, int(fields.get("warc-segment-number", 1)),
                    int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, block,
                ))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
            yield frame.astype({"total_length": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``, continuations apart; archives may be plain or gzip."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_read, RECORDS)


def _body(message: bytes) -> bytes | None:
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _assemble(batches):
    for rows in batches:
        payloads = []
        for numbers, blocks, total in zip(rows["numbers"], rows["blocks"], rows["total_length"], strict=True):
            message = b"".join(bytes(b) for b in blocks)
            whole = list(numbers) == list(range(1, len(blocks) + 1))
            right = pd.isna(total) and len(blocks) == 1 or total == len(message)
            payloads.append(_body(message) if whole and right else None)
        kept = rows[["record_id", "record_type", "target_uri", "key", "refers_to", "digest"]]
        yield kept.assign(payload=payloads, complete=[p is not None for p in payloads])


def reassembled(records: DataFrame) -> DataFrame:
    """One row per message: headers of its first record, ``payload`` and ``complete``.

    Segments read twice count once. A message with a missing segment, a wrong
    total length or broken chunk framing has no payload and is not complete; so
    has a continuation whose first record is lost.
    """
    first = F.when(F.col("origin_id").isNull(), F.struct("record_id", "record_type", "target_uri", "key", "refers_to", "digest"))
    grouped = records.groupBy(F.coalesce("origin_id", "record_id").alias("__origin")).agg(
        F.max(first).alias("head"), F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total_length"))
    return grouped.select(
        F.coalesce("head.record_id", "__origin").alias("record_id"), "head.record_type", "head.target_uri", "head.key",
        "head.refers_to", "head.digest", "total_length", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"),
    ).mapInPandas(_assemble, "record_id string, record_type string, target_uri string, key string, refers_to string, "
                             "digest string, payload binary, complete boolean")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Key, type, length and digest of every page under ``path``, as its decoded payload has them.

    A revisit has those of the response that it names.
    """
    messages = reassembled(read_records(spark, path))
    pages = messages.select(
        "key", "record_type", "refers_to", "complete", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(payload_digest(F.col("payload"))).alias("payload_digest"))
    answered = pages.where("record_type = 'response'").groupBy(
        F.col("key").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    revisits = pages.where("record_type = 'revisit'").join(answered, ["refers_to", "payload_digest"], "left")
    return pages.where("record_type <> 'revisit'").select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(
        revisits.select("key", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
