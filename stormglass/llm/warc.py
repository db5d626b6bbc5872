"""WARC archives of pages with revisit records, read back with boundary-chain verification.

Writing: each task turns its pages into records, each a gzip member of its own with the
skip-length field of the format, and writes them to files of about `file_bytes`. Records are compressed before
they are joined with the table of repeated digests, so pages move in compressed form only.
Files have names of their own for each attempt; a written table of file names decides
which belong to the archive. Of pages with equal payloads of at least `min_revisit` bytes, the one with the largest id is a
response, the others are revisit records that refer to it.

Reading: files are cut into byte ranges. The task of a range reports every place where a member's
first bytes and its skip-length field stand, with the place where the next record would
begin; it reads no further. Such a place may lie inside a payload. Pointer jumping from offset 0 of each file
doubles the followed distance in each round; only the places that the chain reaches are
records, and only those are unpacked and digested. A chain that does not end at the end of its file is an error.

Defined cases: a null html is an empty payload. A null url has no target line; line breaks in
urls are percent-encoded. Headers may be of any length. Pages without an id are responses that refer to nothing; no other
page refers to them. Repeated rows of the largest id are all responses. No pages give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .files import file_system, new_folder, new_name

FILE_BYTES, RANGE_BYTES, MIN_REVISIT = 64 << 20, 8 << 20, 0
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# A gzip member with an extra field: magic, method, flag, time, level, system; then the field "sl" of eight bytes.
_MAGIC = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sH", 12, b"sl", 8)
_LENGTHS = struct.Struct("<II")  # packed bytes of the member, bytes of the record
LEVEL, UNPACK_BYTES = 5, 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, n: int, sha: str, more: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Payload-Length", str(n))]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [*more, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page that `refers_to` names."""
    if refers_to is not None:
        return revisit(page_id, url, len(payload), digest(payload), refers_to)
    more = [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response")]
    return _record(page_id, url, len(payload), digest(payload), more, _HTTP + payload)


def revisit(page_id: int | None, url: str | None, n: int, sha: str, refers_to: int) -> bytes:
    more = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _record(page_id, url, n, sha, more, _HTTP)


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """The record as a gzip member that tells its own packed length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(raw) + packer.flush()
    tail = _LENGTHS.pack(zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = len(_MAGIC) + _LENGTHS.size + len(body) + len(tail)
    return _MAGIC + _LENGTHS.pack(size, len(raw)) + body + tail


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page as a packed response; the payload itself goes no further."""
    for batch in batches:
        ids, urls, payloads = (batch.column(c).to_pylist() for c in range(3))
        packed = [(len(p), digest(p), member(record(i, u, p, None))) for i, u, p in zip(ids, urls, payloads)]
        kinds = pa.int64(), pa.string(), pa.binary()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), *[pa.array([r[i] for r in packed], k) for i, k in enumerate(kinds)]],
            names=["page_id", "url", "sha", "bytes", "digest", "member"])


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    done, out, path, size = [], None, None, 0
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("page_id", "url", "bytes", "digest", "member", "refers_to"))
        for page_id, url, n, sha, packed, refers_to in zip(*cols):
            if out is None:
                path, size = new_name(folder, ".warc.gz"), 0
                system, inner = file_system(path)
                out = system.open_output_stream(inner, compression=None)
            size += out.write(packed if refers_to is None else member(revisit(page_id, url, n, sha, refers_to)))
            if size >= file_bytes:
                out.close()
                done.append((path, size))
                out = None
    if out is not None:
        out.close()
        done.append((path, size))
    yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()),
                                      "size": pa.array([d[1] for d in done], pa.int64())})


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive; returns its files (path, size)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = (rows.filter(F.octet_length("payload") >= min_revisit)
             .groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
             .filter("copies > 1").select("sha", "first"))
    packed = rows.mapInArrow(_encode, "page_id long, url string, sha string, bytes long, digest string, member binary")
    rows = packed.join(first, "sha", "left").withColumn(
        "refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).select(
        "page_id", "url", "bytes", "digest", F.when(F.col("refers_to").isNull(), F.col("member")).alias("member"), "refers_to")
    folder = new_folder(pages.sparkSession, "warc")
    return materialise(rows.mapInArrow(lambda it: _write(it, folder, file_bytes), "path string, size long"),
                       "warc-files")


def parse_header(raw: bytes) -> dict[str, str] | None:
    """Fields of a record header (without the blank line), or None if it is not one."""
    if not raw.startswith(VERSION):
        return None
    fields = {}
    for line in raw[len(VERSION):].split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return fields if length.isascii() and length.isdigit() else None


def _page(text: str | None) -> int | None:
    inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place in a byte range where a record may begin, with its successor."""
    reach = len(_MAGIC) + _LENGTHS.size
    for batch in batches:
        for path, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in ("path", "lo", "hi", "size"))):
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                raw = f.read_at(min(hi + reach, size) - lo, lo)
            found, at = [], raw.find(_MAGIC)
            while 0 <= at < hi - lo:
                if at + reach <= len(raw):
                    found.append((lo + at, lo + at + _LENGTHS.unpack_from(raw, at + len(_MAGIC))[0]))
                at = raw.find(_MAGIC, at + 1)
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([path] * len(found), pa.string()), "size": pa.array([size] * len(found), pa.int64()),
                "pos": pa.array([x[0] for x in found], pa.int64()), "next": pa.array([x[1] for x in found], pa.int64())})


def chain(pos: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, int]:
    """Which places the chain pos -> after reaches from 0, by pointer jumping, and where it ends.

    pos is sorted. Every round marks what the marked places point at and doubles the distance of all pointers.
    """
    n = len(pos)
    at = np.searchsorted(pos, after)
    at[(at < n) & (pos[np.minimum(at, n - 1)] != after)] = n
    jump, on = np.append(at, n), np.zeros(n + 1, dtype=bool)
    on[:1] = n > 0 and pos[0] == 0
    while True:
        seen = on.copy()
        seen[jump[on]] = True
        seen[n] = False
        if (seen == on).all():
            break
        on, jump = seen, jump[jump]
    last = np.flatnonzero(on)
    return on[:n], int(after[last[-1]]) if len(last) else 0


def _reached(key: tuple, table: pa.Table) -> pa.Table:
    """The places of one file that its chain reaches; their number is bounded by the bytes of the file."""
    table = table.sort_by("pos")
    path, size = table.column("path")[0].as_py(), table.column("size")[0].as_py()
    on, end = chain(table.column("pos").to_numpy(), table.column("next").to_numpy())
    if end != size:
        raise ValueError(f"the chain of records of {path} ends at {end} of {size} bytes")
    return table.filter(pa.array(on)).select(["path", "pos", "next"])


def reachable(places: DataFrame) -> DataFrame:
    """The records (path, pos, next) among candidate places (path, size, pos, next)."""
    return places.groupBy("path").applyInArrow(_reached, "path string, pos long, next long")


def _pieces(f, pos: int, end: int) -> Iterator[bytes]:
    """The bytes of the member at pos .. end, a piece at a time."""
    unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
    while pos < end:
        packed = f.read_at(min(UNPACK_BYTES, end - pos), pos)
        pos += len(packed)
        data = b""
        while packed or len(data) == UNPACK_BYTES:
            data = unpack.decompress(packed, UNPACK_BYTES)
            packed = unpack.unconsumed_tail
            if data:
                yield data
    if not unpack.eof or unpack.unused_data:
        raise ValueError(f"a member does not end at {end}")


def _unpacked(f, pos: int, end: int) -> tuple[dict[str, str], int, str]:
    """Header fields of a record, and size and digest of its payload."""
    head, fields, sha, n, left = b"", None, hashlib.sha1(), 0, None
    for data in _pieces(f, pos, end):
        if left is None:  # in the header of the record, then in that of the page
            head += data
            if fields is None and (cut := head.find(b"\r\n\r\n")) >= 0:
                fields, head = parse_header(head[:cut]), head[cut + 4:]
                if fields is None:
                    raise ValueError(f"no record header in the member that ends at {end}")
            if fields is None or (cut := head.find(b"\r\n\r\n")) < 0:
                continue
            left, data = int(fields["content-length"]) - cut - 4, head[cut + 4:]
        sha.update(data[:left])
        n, left = n + min(left, len(data)), left - min(left, len(data))
    if left != 0:
        raise ValueError(f"the record that ends at {end} is cut short")
    return fields, n, base64.b32encode(sha.digest()).decode()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()))
    f = path = None
    for batch in batches:
        rows = []
        for at, pos, end in zip(*(batch.column(c).to_pylist() for c in ("path", "pos", "next"))):
            if at != path:
                if f:
                    f.close()
                system, inner = file_system(at)
                f, path = system.open_input_file(inner), at
            fields, n, sha = _unpacked(f, pos, end)
            again = fields.get("warc-type") == "revisit"
            rows.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"),
                         _page(fields.get("warc-refers-to")) if again else None,
                         int(fields.get("warc-payload-length", "0")) if again else n,
                         fields.get("warc-payload-digest", "").removeprefix("sha1:") if again else sha))
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})
    if f:
        f.close()


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest."""
    ranges = files.filter("size > 0").select("path", "size", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("lo")).withColumn(
        "hi", F.least(F.col("lo") + range_bytes, F.col("size")))
    tasks = max(1, ranges.count())
    places = ranges.repartition(tasks, "path", "lo").mapInArrow(_candidates, "path string, size long, pos long, next long")
    records = materialise(reachable(places), "records").withColumn("part", F.floor(F.col("pos") / range_bytes))
    return (records.repartition(tasks, "path", "part").sortWithinPartitions("path", "pos").drop("part").mapInArrow(
        _read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"))
