"""WARC archives: written with revisit records for equal payloads, read back with salvage.

``write_archives`` writes one gzip member per record, several archives side by side: each task streams its
records into files of bounded size under a shared folder, each written under a name of the attempt and then
moved to its final one, so a task that runs again leaves the same files.

``read_archives`` checks every member (gzip checksum) and record (version line, length, block and payload
digest; SHA-1, SHA-256, SHA-512 and MD5 in hex or base32, others are noted in ``reason`` and not checked).  After a failed check it
searches for the next place where a gzip member or a version line starts a valid record, goes on from there, and
reports the bytes between as a quarantined gap with the first reason.  A member may hold any number of records: each
is returned when the next one has begun or the member's checksum is right; if a member breaks off, the gap starts at
the member and ``reason`` tells how many of its records were read.  Plain (uncompressed) archives and mixed ones are
read alike.  Files are read and inflated in pieces; a record is held whole.

Defined results: null html is an empty payload; a null URL becomes a URN of the record; null page ids are
written without one and read back as null, and never are the original of a revisit unless all equal payloads
lack an id (then all are responses); repeated rows of the smallest id are all responses; an empty table writes
nothing; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import prepare
from loglens.operators.blocks import filesystem
from loglens.operators.sizes import broadcast_if_small

VERSION = b"WARC/1.1\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: payloads from this size on are revisited; bytes of an archive; bytes read, or returned, at a time
LEAST_SHARED, ARCHIVE_BYTES, PIECE = 100, 64 << 20, 1 << 18
LEVEL = 2
URN = "urn:x-page:"
FIELDS = "path string, offset long, stop long, kind string, reason string, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ------------------------------------------------------------ writing
def encode_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record.  A revisit holds the HTTP head alone, which tells the length of the payload."""
    name = URN + quote(page_id or "", safe="")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else name), ("WARC-Payload-Digest", "sha256:" + digest), ("WARC-Block-Digest", "sha256:" + _hex(block)),
        *([("WARC-Refers-To", f"<{URN}{quote(refers_to, safe='')}>"), ("WARC-Profile", PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt, number = task.partitionId(), task.taskAttemptId(), 0
        sink, size, records, done = None, 0, 0, []

        def close() -> None:
            nonlocal sink, size, records, number
            if sink is not None:
                sink.close()
                name = f"{root}/part-{part:06d}-{number:05d}.warc.gz"
                where.move(f"{root}/.{part}-{number}-{attempt}", name)
                done.append((f"part-{part:06d}-{number:05d}.warc.gz", size, records))
                sink, size, records, number = None, 0, 0, number + 1

        for b in batches:
            for page_id, url, html, digest, refers in zip(*(b[c].to_pylist() for c in ("id", "url", "html", "digest", "refers"))):
                data = member(encode_record(page_id, url, (html or "").encode(), digest, refers))
                if sink is None:
                    sink = where.open_output_stream(f"{root}/.{part}-{number}-{attempt}")
                sink.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return run


def with_originals(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """(id, url, html, digest, refers): refers is the smallest id with an equal payload, for all other rows."""
    prepare(pages)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    big = F.octet_length("html") >= least
    shared = (rows.filter(big).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
              .select(F.col("digest").alias("d"), "first")).checkpoint()
    rows = rows.join(broadcast_if_small(shared), (F.col("digest") == F.col("d")) & big, "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    return rows.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", refers.cast("string").alias("refers"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; (path, bytes, records) of each, paths below ``folder``."""
    rows = with_originals(pages, id_col, url_col, html_col)
    return rows.mapInArrow(_write(folder, archive_bytes), "path string, bytes long, records long").checkpoint()


# ------------------------------------------------------------ reading
class Bad(Exception):
    """A failed check."""


class Window:
    """Random access to a file by pieces, the last ones kept."""

    def __init__(self, source):
        self.source, self.size, self.at, self.data = source, source.size(), 0, b""

    def read(self, start: int, n: int) -> bytes:
        stop = min(start + n, self.size)
        if start < self.at or stop > self.at + len(self.data):
            self.source.seek(start)
            self.at, self.data = start, self.source.read(max(stop - start, PIECE))
        return self.data[start - self.at:stop - self.at]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _plain_head(w: Window, start: int) -> bytes:
    data = b""
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = w.read(start + len(data), 4096)
        if not more or len(data) > 1 << 20:
            raise Bad("header without end")
        data += more
    return data[:end]


#: digest algorithms that are checked, with their lengths in bytes
DIGESTS = {"md5": 16, "sha1": 20, "sha-1": 20, "sha256": 32, "sha-256": 32, "sha512": 64, "sha-512": 64}


def check_digest(what: str, stated: str, *data: bytes) -> str | None:
    """None where the stated digest is that of one of ``data``, a note where it cannot be checked, else Bad."""
    algorithm, _, value = stated.partition(":")
    algorithm, value = algorithm.strip().lower(), value.strip()
    size = DIGESTS.get(algorithm)
    if size is None:
        return f"{what} digest not checked: {algorithm or 'none'}"
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
    except (ValueError, binascii.Error):
        raise Bad(f"{what} digest") from None
    if not any(hashlib.new(algorithm.replace("-", ""), d).digest() == raw for d in data):
        raise Bad(f"{what} digest")
    return None


def _dechunked(body: bytes) -> bytes | None:
    """The body without its chunked transfer coding, if it has one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2


def _length(fields: dict[str, str]) -> int:
    if not (fields.get("content-length") or "").isdigit():
        raise Bad("no content length")
    return int(fields["content-length"])


def _record(head: bytes, block: bytes) -> dict:
    fields, note = _fields(head), None
    if "warc-block-digest" in fields:
        note = check_digest("block", fields["warc-block-digest"], block)
    return {"fields": fields, "block": block, "note": note}


def _plain(w: Window, start: int) -> Iterator[tuple[dict, int, int | None]]:
    """The uncompressed record at ``start``, as from ``_member``."""
    head = _plain_head(w, start)
    n, at = _length(_fields(head)), start + len(head) + 4
    if at + n + 4 > w.size:
        raise Bad("truncated record")
    rest = w.read(at, n + 4)
    if rest[n:] != b"\r\n\r\n":
        raise Bad("length")
    yield _record(head, rest[:n]), at + n + 4, at + n + 4


def _member(w: Window, start: int) -> Iterator[tuple[dict, int, int | None]]:
    """The records of the gzip member at ``start``, inflated in pieces: each with the place from which on nothing of it
    is read, and the last one with the member's end."""
    z, data, at = zlib.decompressobj(31), bytearray(), start

    def fill(enough) -> bool:
        """Inflates until ``enough()`` or the end of the member."""
        nonlocal at
        while not enough():
            if z.eof:
                return False
            piece = w.read(at, PIECE >> 4)
            if not piece:
                raise Bad("truncated member")
            try:
                data.extend(z.decompress(piece))
            except zlib.error as e:
                raise Bad(f"gzip: {str(e).split(':')[0]}") from None
            at += len(piece)
        return True

    held = None
    while True:
        fill(lambda: len(data) >= len(VERSION))
        if held is not None and not data:
            break
        if not START.match(data) or data[:1] == b"\x1f":
            raise Bad("member without version line" if held is None else "no version line")
        if held is not None:
            yield held, max(start, at - len(data)), None
        if not fill(lambda: b"\r\n\r\n" in data or len(data) > 1 << 20) or b"\r\n\r\n" not in data:
            raise Bad("header without end")
        end = data.index(b"\r\n\r\n")
        head = bytes(data[:end])
        n = _length(_fields(head))
        if not fill(lambda: len(data) >= end + n + 8) or data[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
            raise Bad("length")
        held = _record(head, bytes(data[end + 4:end + 4 + n]))
        del data[:end + 8 + n]
    stop = at - len(z.unused_data)
    yield held, stop, stop  # the member is whole and its checksum right


def parse(w: Window, start: int) -> Iterator[tuple[dict, int, int | None]]:
    """The records of the member or plain record at ``start``; Bad where a check fails."""
    first = w.read(start, 12)
    if first[:3] == b"\x1f\x8b\x08":
        yield from _member(w, start)
    elif START.match(first):
        yield from _plain(w, start)
    else:
        raise Bad("no member or version line")


def _row(path: str, start: int, stop: int | None, record: dict) -> tuple:
    fields, block, note = record["fields"], record["block"], record["note"]
    kind = fields.get("warc-type", "")
    payload, size = None, None
    stated = fields.get("warc-payload-digest", "")
    if fields.get("content-type", "").startswith("application/http"):
        head, _, rest = block.partition(b"\r\n\r\n")
        size = len(rest)
        if kind == "revisit":
            told = _fields(head).get("content-length", "")
            size = int(told) if told.isdigit() else None
        else:
            payload = rest
            if stated:
                # some writers take the digest before, others after the transfer coding is undone
                plain = _dechunked(rest) if "chunked" in _fields(head).get("transfer-encoding", "").lower() else None
                note = check_digest("payload", stated, *([rest] if plain is None else [rest, plain])) or note
    name = lambda v: unquote(v.strip("<>").removeprefix(URN)) or None
    return (path, start, stop, "record", note, kind, name(fields.get("warc-record-id", "")), fields.get("warc-target-uri"),
            name(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, stated.removeprefix("sha256:") or None, size, payload)


def salvage(source, path: str) -> Iterator[tuple]:
    """Rows of ``FIELDS`` for a file: valid records, and a gap for every stretch between them.  ``stop`` of a record is
    where its member ends, null for the earlier ones of a member."""
    w = Window(source)

    def rows(start: int) -> Iterator[tuple[tuple, int, int | None]]:
        return ((_row(path, start, stop, record), resume, stop) for record, resume, stop in parse(w, start))

    begin, read, found = 0, 0, rows(0)
    while begin < w.size:
        try:
            row, resume, stop = next(found)
            yield row
            read += 1
            if stop is not None:
                begin, read, found = stop, 0, rows(stop)
            continue
        except Bad as e:
            reason = f"{e} after {read} records of the member" if read else str(e)
        look, first = max(begin + 1, resume if read else 0), None
        while first is None and look < w.size:
            piece = w.read(look, PIECE)
            for m in START.finditer(piece):
                at, found = look + m.start(), rows(look + m.start())
                try:
                    first = next(found)
                    break
                except Bad:
                    continue
            # a mark may lie across the end of the piece
            look = w.size if look + len(piece) >= w.size else look + len(piece) - 9
        yield (path, begin, w.size if first is None else at, "gap", reason, None, None, None, None, None, None, None)
        if first is None:
            return
        row, resume, stop = first
        yield row
        begin, read = at, 1
        if stop is not None:
            begin, read, found = stop, 0, rows(stop)


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of ``FIELDS`` for the archives named by ``files.path``: kind is record or gap."""
    prepare(files)
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        for b in batches:
            for path in b["path"].to_pylist():
                rows, held = [], 0
                with where.open_input_file(f"{root}/{path}") as source:
                    for row in salvage(source, path):
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(rows[-1][-1] or b"") + 200
                        if held >= PIECE * 16:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.select("path").mapInArrow(run, FIELDS)
