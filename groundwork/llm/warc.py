"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

Writing: each task writes files of its own in a folder that all machines share (any file system
pyarrow can open) and gives back their names; only files of finished tasks are in the list, so
a lost or repeated task leaves no record twice. Reading: a task takes a byte range, looks for
the gzip magic, accepts a member if its first bytes decode to a WARC header, and owns the
records that start inside its range; the last one is read to its end beyond the range.

Null html is an empty payload. Records with equal payloads and the same smallest page_id are
all responses; a record without page_id is a response. A member that breaks off or whose
payload does not have its digest gives a row with `fault` set, never an exception. Within a
text payload the magic cannot occur (0x8B never follows 0x1F in UTF-8), so no member that
this writer makes hides another one.
"""

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from groundwork import session
from groundwork.llm import shared

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
PIECE = 1 << 13
#: Archives are closed beyond so many bytes, and read in ranges of so many.
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
#: Payloads shorter than this are never replaced by a revisit record.
MIN_REVISIT_BYTES = 0
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, bytes long, records long"
RECORDS = ("path string, offset long, record_type string, page_id long, url string, payload binary, payload_bytes long, "
           "payload_digest string, refers_to long, fault string")


def _store(path):
    """File system and path in it; Spark writes local paths as file:/..."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def revisits(pages, min_bytes=MIN_REVISIT_BYTES):
    """Pages with `payload` and `refers_to`: the smallest page_id with an equal payload, null for that page itself.

    Only ids and digests are grouped and joined; a digest that very many pages share is first
    reduced map-side, and in the join it is on the larger side only, which Spark can split.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("__sha", F.sha1("payload")).withColumn("__n", F.length("payload"))
    keys = pages.filter(F.col("__n") >= min_bytes).select("page_id", "__sha", "__n")
    first = keys.groupBy("__sha", "__n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = keys.join(first, ["__sha", "__n"]).filter("page_id > refers_to").select("page_id", "__sha", "refers_to").distinct()
    return pages.join(later, ["page_id", "__sha"], "left").select("page_id", "url", "payload", "refers_to")


def record(page_id, url, payload, refers_to):
    """A record as one gzip member."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=-._~|"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def write(records, folder, file_bytes=FILE_BYTES):
    """Archives in `folder`; a staged table of their paths and sizes."""
    def write_part(batches):
        store, top = _store(folder)
        out, path, done, size, n = None, None, [], 0, 0
        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, n))
                out = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    path, size, n = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(top + path[len(folder):], compression=None)
                member = record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 3, (pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "bytes", "records"])
    return shared.stage(records.mapInArrow(write_part, FILES))


class Window:
    """Bytes of a file by position, read in blocks."""

    def __init__(self, file, size):
        self.file, self.size, self.base, self.block = file, size, 0, b""

    def get(self, at, n):
        n = min(n, self.size - at)
        if at < self.base or at + n > self.base + len(self.block):
            self.file.seek(at)
            self.base, self.block = at, self.file.read(max(n, BLOCK))
        return self.block[at - self.base:at - self.base + max(n, 0)]


def members(window, start, end):
    """(offset, decoded bytes, whole) of the members that begin in [start, end)."""
    at = start
    while at < end:
        piece = window.get(at, BLOCK)
        hit = piece.find(MAGIC)
        if hit < 0:
            at += max(1, len(piece) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        found = _member(window, at)
        if found is None:
            at += 1
            continue
        data, after, whole = found
        yield at, data, whole
        at = after


def _member(window, at):
    unpack, parts, pos, checked = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof and pos < window.size:
            piece = window.get(pos, PIECE)
            parts.append(unpack.decompress(piece))
            pos += len(piece)
            if not checked:
                begun = b"".join(parts)[:7]
                if b"WARC/1."[:len(begun)] != begun:
                    return None
                checked = len(begun) == 7
    except zlib.error:
        data = _salvaged(window, at)
        return (data, at + len(MAGIC), False) if data.startswith(b"WARC/1.") else None
    if not checked:
        return None
    return b"".join(parts), pos - len(unpack.unused_data), unpack.eof


def _salvaged(window, at):
    """What a damaged member gives before the damage, in small steps, since a step that fails gives nothing."""
    unpack, parts, pos, tail = zlib.decompressobj(31), [], at, b""
    try:
        while not unpack.eof and (tail or pos < window.size):
            if not tail:
                tail = window.get(pos, PIECE)
                pos += len(tail)
            parts.append(unpack.decompress(tail, 64))
            tail = unpack.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(parts)


def parse(data, whole):
    """Fields of a record in the order of RECORDS, from record_type on."""
    head, gap, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    def page(name):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    length = fields.get("content-length", "")
    fault = None if whole and gap and length.isdigit() and len(block) >= int(length) else "broken off"
    block = block[:int(length)] if length.isdigit() else block
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        stated = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
        payload, size = None, int(stated[1]) if stated else None
    else:
        size = len(payload)
        if fault is None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            fault = "digest"
    return kind, page("warc-record-id"), fields.get("warc-target-uri"), payload, size, digest, page("warc-refers-to"), fault


def read(files, range_bytes=RANGE_BYTES):
    """One row per record of the archives in `files` (path, bytes)."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    ranges = ranges.repartition(max(1, -(-total // range_bytes)), F.col("path"), F.col("start"))  # about a range a task
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = [field.split()[0] for field in RECORDS.split(", ")]

    def read_part(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                store, inside = _store(path)
                with store.open_input_file(inside) as file:
                    rows, held = [], 0
                    for offset, data, whole in members(Window(file, size), start, min(start + range_bytes, size)):
                        rows.append((path, offset, *parse(data, whole)))
                        held += len(data)
                        if held > 4 * BLOCK:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names)
    return ranges.mapInArrow(read_part, RECORDS)


def folder(spark):
    """A new folder beside the staged tables, which every executor can reach."""
    session.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def op9_warc(spark, sf_dir):
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write(revisits(pages), folder(spark))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")


QUERIES = {"op9_warc": op9_warc}

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHARS = " || ".join(f"substr('{_B32}', ((v >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0))

ORACLES = {"op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT), lambda v: {_CHARS}), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM f
"""}
