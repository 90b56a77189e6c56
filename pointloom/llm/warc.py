"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

The reader checks every record: version line, headers, length, closing lines, and the
digests the record names.  After a failed check it searches on for the next gzip member or
version line that begins a valid record, goes on from there, and logs the bytes between as
a quarantined gap.  Within a gzip member of many records it searches the decompressed bytes
likewise, as far as they can be decompressed; such a gap names its offset in the member.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Rolling, open_in
from .frames import map_batches, new_path, written

MIN_PAYLOAD = 100
FILE_BYTES = 64 << 20
#: Digests of repeated payloads that are sent to every task at most: some 10 MB.
SENT_DIGESTS = 100_000
_CHUNK = 1 << 20
_GZIP, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_SIGNATURE = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
SCHEMA = "path string, at long, n_bytes long, kind string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


# Writing


def record(page: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One record: an HTTP response, without its payload where it is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(it, folder: str, limit: int, compress: bool):
    out, made = Rolling(folder, ".warc.gz" if compress else ".warc", limit), {}
    for b in it:
        for page, url, html, kind, first in zip(*(c.to_pylist() for c in b.columns)):
            uri = out.room()
            data = record(page, url, html or b"", kind, first)
            out.write(gzipped(data) if compress else data)
            made[uri] = made.get(uri, 0) + 1
    out.close()
    yield pa.RecordBatch.from_arrays([pa.array(list(made)), pa.array(list(made.values()), pa.int64())], names=["path", "n_records"]) if made else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], names=["path", "n_records"])


def with_revisits(pages: DataFrame, least: int = MIN_PAYLOAD, most: int = SENT_DIGESTS) -> DataFrame:
    """page_id, url, html, kind, refers_to: of equal payloads of ``least`` bytes or more the smallest page_id is the response.

    Payloads are compared by SHA-256.  Only digests are shuffled to find those that occur
    twice, one row per digest and task.  Where these are at most ``most`` they go to every
    task and payloads stay where they are; else payloads join them by digest, those under
    ``least`` bytes by keys of their own.  Rows without a page_id are responses where no row
    of their group has one.  Rows that repeat the smallest page_id are responses each.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    long = p.where(F.length("html") >= least)
    first = long.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = written(first, "repeated-payloads")
    own = F.encode(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")), "UTF-8")
    p = p.withColumn("digest", F.when(F.length("html") >= least, digest).otherwise(own))
    j = p.join(F.broadcast(first) if first.count() <= most else first, "digest", "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "html", F.when(later, "revisit").otherwise("response").alias("kind"), F.when(later, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, limit: int = FILE_BYTES, compress: bool = True) -> DataFrame:
    """Write a record per row of :func:`with_revisits`; returns (path, n_records), a table already written."""
    return written(map_batches(pages, lambda it: _write(it, folder, limit, compress), "path string, n_records long"), "warc-files")


# Reading


class _Bad(Exception):
    pass


@dataclass
class _Window:
    """A file read in chunks; ``take`` gives bytes at any place."""

    file: object
    size: int
    start: int = 0
    data: bytes = b""

    def take(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.start or at + n > self.start + len(self.data):
            self.data, self.start = self.file.read_at(min(max(n, _CHUNK), self.size - at), at), at
        return self.data[at - self.start : at - self.start + n]


def _before_error(z, part: bytes) -> bytes:
    """What a decompressor makes of the bytes before its error: in pieces, then byte by byte."""
    out = []
    for step in (1024, 1):
        while part:
            saved = z.copy()
            try:
                out.append(z.decompress(part[:step]))
            except zlib.error:
                z = saved
                break
            part = part[step:]
    return b"".join(out)


def _member(w: _Window, at: int) -> tuple[bytes, int | None, str | None]:
    """The content of the gzip member at a place and where it ends; or what comes before an error, and the error."""
    z, out, p = zlib.decompressobj(31), [], at
    while not z.eof:
        part = w.take(p, 1 << 16)
        if not part:
            return b"".join(out), None, "the member is cut off"
        saved = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            return b"".join([*out, _before_error(saved, part)]), None, f"gzip: {e}"
        p += len(part)
    return b"".join(out), p - len(z.unused_data), None


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("a header line has no colon")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _parsed(head: bytes, body: bytes) -> dict:
    h = _headers(head)
    if want := h.get("warc-block-digest", ""):
        if want.startswith("sha256:") and hashlib.sha256(body).hexdigest() != want[7:]:
            raise _Bad("the block's digest differs")
    kind, payload, n = h.get("warc-type"), body, len(body)
    if kind in ("response", "revisit") and body.startswith(b"HTTP/"):
        http, sep, payload = body.partition(b"\r\n\r\n")
        if not sep:
            raise _Bad("the HTTP head has no end")
        n = len(payload)
        if kind == "revisit":
            said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            n = int(said[1]) if said else None
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind != "revisit":
        own = hashlib.sha256(payload).hexdigest()
        if h.get("warc-payload-digest", "").startswith("sha256:") and own != digest:
            raise _Bad("the payload's digest differs")
        digest = own
    return {"record_type": kind, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": n, "payload": payload if kind != "revisit" else None}


def _length(head: bytes) -> int:
    n = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    if not n:
        raise _Bad("no Content-Length")
    return int(n[1])


def _one(data: bytes, p: int) -> tuple[dict, int]:
    """The record at a place of a member's content, and where it ends."""
    line = _VERSION_LINE.match(data, p)
    if not line:
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", line.end())
    if end < 0:
        raise _Bad("the head has no end")
    head, body = data[line.end() : end], end + 4
    stop = body + _length(head)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("the record does not end where it says")
    return _parsed(head, data[body:stop]), stop + 4


def _in_member(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of a member's content, and (offset, bytes, reason) of what lies between them."""
    out, gaps, p = [], [], 0
    while p < len(data):
        try:
            r, end = _one(data, p)
        except _Bad as e:
            gap, why, r = p, str(e), None
            while r is None and (line := _VERSION_LINE.search(data, p + 1)):
                p = line.start()
                try:
                    r, end = _one(data, p)
                except _Bad:
                    continue
            if r is None:
                p = end = len(data)
            gaps.append((gap, p - gap, why))
        if r is not None:
            out.append(r)
        p = end
    return out, gaps


def _plain(w: _Window, at: int) -> tuple[list[dict], int]:
    n = 4096
    while True:
        head = w.take(at, n)
        line = _VERSION_LINE.match(head)
        if not line:
            raise _Bad("no version line")
        end = head.find(b"\r\n\r\n", line.end())
        if end >= 0:
            break
        if len(head) < n or n > 1 << 24:
            raise _Bad("the head has no end")
        n *= 4
    body = at + end + 4
    stop = body + _length(head[line.end() : end])
    if stop + 4 > w.size or w.take(stop, 4) != b"\r\n\r\n":
        raise _Bad("the record does not end where it says")
    return [_parsed(head[line.end() : end], w.take(body, stop - body))], stop + 4


def _at(w: _Window, at: int) -> tuple[list[dict], list[str], int | None]:
    """The records at a place, what is lost between them, and where they end: null for a member that breaks off."""
    lead = w.take(at, 7)
    if lead.startswith(_GZIP):
        data, end, error = _member(w, at)
        records, gaps = _in_member(data)
        # The checksum covers the heads, digests do not: a broken member's only record may be what is broken.
        if (error or gaps) and (not records or error and len(records) == 1 and not gaps):
            raise _Bad(error or gaps[0][2])
        notes = [f"{n} bytes from {p} in the member: {why}" for p, n, why in gaps]
        return records, notes + [f"from {len(data)} in the member: {error}"] * bool(error), end
    if lead.startswith(_VERSION):
        records, end = _plain(w, at)
        return records, [], end
    raise _Bad("neither a member nor a version line")


def _next(w: _Window, at: int) -> int:
    """The next place that looks like the start of a member or record, or the end of the file."""
    while at < w.size:
        data = w.take(at, _CHUNK)
        if m := _SIGNATURE.search(data):
            return at + m.start()
        at += max(1, len(data) - 6) if at + len(data) < w.size else len(data)
    return w.size


def salvage(file, size: int) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(at, bytes, reason, record): records, with no reason, and gaps, with no record, in file order.

    What a gzip member has lost follows its records, with the member's place and length; the
    reason gives the offset in its content.
    """
    w, at, ahead = _Window(file, size), 0, None
    while at < size:
        start, here, why, end = at, ahead, None, None
        ahead = None
        try:
            here = here or _at(w, at)
            end = here[2]
        except _Bad as e:
            why = str(e)
        if end is None:
            end = start
            while (end := _next(w, end + 1)) < size:
                try:
                    ahead = _at(w, end)
                    break
                except _Bad:
                    continue
        records, notes = here[:2] if here else ([], [why])
        for r in records:
            yield start, end - start, None, r
        for note in notes:
            yield start, end - start, note, None
        at = end


_FIELDS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("n_bytes", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), *((f, pa.string()) for f in _FIELDS[:5]), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _read(it, payloads: bool):
    for b in it:
        for path in b.column(0).to_pylist():
            with open_in(path) as f:
                rows, held = [], 0
                for at, n, why, r in salvage(f, f.size()):
                    row = {"path": path, "at": at, "n_bytes": n, "kind": "gap" if r is None else "record", "reason": why} | (r or {})
                    held += len(row.get("payload") or b"") + 500
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives named by ``path``, each archive once.

    Archives are read as streams, in chunks; a task holds one record at a time.  An empty
    archive has no rows; null paths are left out.  ``payloads=False`` checks payloads but
    does not return them.
    """
    paths = files.select("path").where("path is not null").distinct()
    n = max(1, paths.count())
    return map_batches(paths.repartition(min(n, 10_000)), lambda it: _read(it, payloads), SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page and read the archives back: what each record says.

    A null html is an empty payload; a null page_id stays null, a null url is left out of the head;
    repeated rows are records each; other columns are not read; an empty table gives no rows.
    """
    files = write(with_revisits(pages), new_path(pages.sparkSession, "warc"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read(files, payloads=False).where("kind = 'record'").select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
