"""WARC archives: written through Spark's text sink, read back in byte ranges.

Writing: every record is one gzip member. Payloads are told apart by SHA-1; of equal
payloads of at least ``min_revisit`` bytes the record with the smallest id is the
response and the others are revisits of it. Members are written as raw lines whose
separator is an empty gzip member, so files are plain multi-member gzip and come from
Spark's own commit protocol, which retries and lost executors do not harm.

Reading: a file is cut into byte ranges. A task looks for the gzip magic in its range,
decodes the start of each candidate and takes it for a record only if it holds a WARC
header and the whole member decodes; it owns the records that start inside its range and
reads past the end of it for the last one. Payloads are digested as they stream.

Defined cases: a null payload is empty. Rows with the smallest id of their payload are
all responses, if rows repeat; a null id is never the smallest unless all are null, and
refers to nothing. An empty table gives no records. A stored archive inside a record that
is itself stored uncompressed could be taken for records; compressed ones cannot.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketspark.llm.text import as_bytes, map_batches, schema_of
from marketspark.session import bounded_broadcast, ensure_checkpoint_dir, stage

# Fixed values of the two formats.
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"

RANGE_BYTES = 16 << 20
BLOCK = 1 << 18

RECORD = schema_of(
    ("record_id", T.StringType()), ("record_type", T.StringType()), ("target_uri", T.StringType()), ("refers_to", T.StringType()),
    ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("payload", T.BinaryType()),
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]+", "%20", (value or "").strip())


def member(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + END) + packer.compress(block + END) + packer.flush()


def record_name(value) -> str:
    return f"urn:page:{'' if value is None else value}"


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> None:
    """Write one record per row below ``path``."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload")
    )
    # only the narrow (digest, id) side is grouped; ids come back by id, of which none is hot, and payloads move only if the revisits are many
    keyed = rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_revisit)
    first = keyed.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = keyed.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    told = rows.join(bounded_broadcast(stage(later)), F.col("id").eqNullSafe(F.col("_id")) & (F.sha1("payload") == F.col("_digest")), "left").select("id", "uri", "payload", "first")

    def step(batch):
        ids, uris, firsts = (batch.column(k).to_pylist() for k in (0, 1, 3))
        return [[
            member(record_name(i), uri, payload, None if first is None else record_name(first))
            for i, uri, payload, first in zip(ids, uris, as_bytes(batch.column(2)), firsts)
        ]]

    members = map_batches(told, schema_of(("member", T.BinaryType())), step)
    members.select(F.col("member").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


class _Window:
    """Bytes of an open file from a position on, read in blocks."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, count: int = BLOCK) -> bytes:
        count = min(count, self.size - at)
        return self.file.read_at(count, at) if count > 0 else b""


def _header(window: _Window, at: int) -> dict[str, str] | None:
    """The WARC header of the member that starts at ``at``, or None if there is none."""
    unpack, text, seen = zlib.decompressobj(31), bytearray(), 0
    try:
        while text.find(END, max(seen - len(END) + 1, 0)) < 0 and not unpack.eof:
            seen, data = len(text), unpack.unconsumed_tail
            if not data:
                data = window.read(at, 1 << 12)
                if not data:
                    break
                at += len(data)
            text += unpack.decompress(data, 1 << 16)
            if text and not text.startswith(b"WARC/1."[: len(text)]):
                return None
    except zlib.error:
        return None
    head, found, _ = text.partition(END)
    if not found or not head.startswith(b"WARC/1."):
        return None
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _member(window: _Window, at: int, keep: bool) -> tuple[int, dict] | None:
    """(end, HTTP length, digest and bytes of the payload) of the whole member at ``at``; None if it does not decode."""
    unpack, digest, position = zlib.decompressobj(31), hashlib.sha1(), at
    head, parts, left, total = b"", [], None, 0
    try:
        while not unpack.eof:
            data = unpack.unconsumed_tail or window.read(position)
            if not unpack.unconsumed_tail:
                if not data:
                    return None
                position += len(data)
            out = unpack.decompress(data, BLOCK)
            if left is None:
                head += out
                warc, found, rest = head.partition(END)
                if not found:
                    continue
                size = re.search(rb"(?im)^content-length:\s*(\d+)", warc)
                block_left = int(size[1]) if size else 0
                http, found, body = rest.partition(END)
                if not found and len(rest) < block_left:
                    continue
                left = max(0, block_left - len(http) - len(END))
                length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                declared, out = int(length[1]) if length else left, body
            out = out[:left]
            left -= len(out)
            total += len(out)
            digest.update(out)
            if keep and out:
                parts.append(out)
    except zlib.error:
        return None
    if left is None:
        return None
    return position - len(unpack.unused_data), {
        "declared": declared, "stored": total, "digest": base64.b32encode(digest.digest()).decode(), "payload": b"".join(parts) if keep else None,
    }


def records(window: _Window, start: int, stop: int, keep: bool):
    """Records that start in [start, stop)."""
    at = start
    while at < stop:
        data = window.read(at, min(BLOCK, stop - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0 or at + found >= stop:
            at += max(len(data) - len(MAGIC) + 1, 1)
            continue
        at += found
        header = _header(window, at)
        whole = _member(window, at, keep) if header is not None else None
        if whole is None:
            at += 1
            continue
        at, body = whole
        yield header, body


def _named(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of all files below ``path``: ids, type, digest and length of the full payload, and its bytes if asked for."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    pieces = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    arrow = to_arrow_schema(RECORD)
    spread = pieces.repartition(max(1, spark.sparkContext.defaultParallelism), "path", "start")

    def run(batches):
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = fs.FileSystem.from_uri(file)
                with system.open_input_file(inner) as handle:
                    held, held_bytes = [], 0
                    for header, body in records(_Window(handle, size), start, min(start + range_bytes, size), payloads):
                        kind = header.get("warc-type", "")
                        digest = f"sha1:{body['digest']}" if kind == "response" else header.get("warc-payload-digest", "")
                        held.append({
                            "record_id": _named(header.get("warc-record-id")), "record_type": kind, "target_uri": header.get("warc-target-uri"),
                            "refers_to": _named(header.get("warc-refers-to")), "payload_digest": digest.removeprefix("sha1:"),
                            "payload_bytes": body["declared"] if kind == "revisit" else body["stored"], "payload": body["payload"],
                        })
                        held_bytes += len(body["payload"] or b"") + 200
                        if held_bytes > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held, held_bytes = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return spread.mapInArrow(run, RECORD)


def archived(pages: DataFrame, path: str | None = None, min_revisit: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc-{uuid4().hex}"
    write(pages, path, min_revisit=min_revisit)
    kind = pages.schema["page_id"].dataType

    def number(name):
        return F.nullif(F.substring_index(name, ":", -1), F.lit("")).cast(kind)

    return read(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
