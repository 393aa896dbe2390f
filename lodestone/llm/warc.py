"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads them in place.

An archive is a ZIP file whose members are stored, not deflated: archive/*.warc.gz holds one gzip member
for each record, indexes/*.cdxj one line for each record with its member, offset and length. The reader
finds the central directory from the end of the file (ZIP64 directories and extra fields included),
locates the stored members, and reads single records by their ranges. Nothing is unpacked to disk.
Archives without an index are read record by record from the start of each member, a bounded window at a time. An
index that names a member or a range that is not there, a record that is cut off or has no length, a compressed member
and a file without a directory are errors that name the archive; records that an index names twice are read once.

Every row becomes a record. A null payload counts as empty. Of equal payloads of at least
`least_revisit` bytes that with the smallest id is a response and the others are revisits of it; rows that
repeat that smallest id are responses too, as are rows with a null id, which none can refer to. Payloads
of any length are taken whole. An empty table writes no archives. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_schema, batch, scratch, table

#: Bytes of records after which a member, and of members after which an archive, is closed.
MEMBER_BYTES, ARCHIVE_BYTES = 8 << 20, 24 << 20
#: Bytes of a member whose records one task reads, bytes read at a time, and bytes of them that are unpacked at a time.
SPAN, READ, PIECE = 8 << 20, 1 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
RECORDS = "path string, member string, offset bigint, length bigint, record_id string, warc_type string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length bigint, payload binary"


# ---- records


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record, as a gzip member of its own. A revisit has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Fields of one record, uncompressed. payload_length is that of the full payload, which a revisit's
    HTTP head still states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h.get("content-length", 0))]
    payload, length = block, len(block)
    if "application/http" in h.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    bare = lambda v: v[1:-1] if v and v[0] == "<" else v
    return {"record_id": bare(h.get("warc-record-id")), "warc_type": h.get("warc-type"), "target_uri": bare(h.get("warc-target-uri")), "warc_date": h.get("warc-date"), "refers_to": bare(h.get("warc-refers-to")), "payload_digest": (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, "payload_length": length, "payload": payload}


# ---- ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    header: int  # where its local header is
    size: int
    method: int


EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def directory(f, size: int) -> list[Member]:
    """Members of the ZIP file f (with read_at(n, offset)), from its central directory."""
    tail_at = max(0, size - 65536 - 22 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and tail[at + 20 : at + 22] != struct.pack("<H", max(0, len(tail) - at - 22) & 0xFFFF):  # the mark may be in the comment
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        (where,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        end = f.read_at(56, where)
        if end[:4] != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    raw, out, p = f.read_at(length, start), [], 0
    for _ in range(count):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        packed, plain = struct.unpack_from("<II", raw, p + 20)
        n, extra, comment = struct.unpack_from("<HHH", raw, p + 28)
        (header,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        x, end = p + 46 + n, p + 46 + n + extra
        while x + 4 <= end:
            tag, m = struct.unpack_from("<HH", raw, x)
            if tag == 1:  # ZIP64: those fields that overflowed, in this order
                wide = x + 4
                if plain == 0xFFFFFFFF:
                    wide += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", raw, wide)
                    wide += 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", raw, wide)
            x += 4 + m
        out.append(Member(name, header, packed, method))
        p = end + comment
    return out


def data_start(f, m: Member) -> int:
    """Where the data of a stored member starts; its local extra field may differ from the central one."""
    h = f.read_at(30, m.header)
    if h[:4] != LOCAL:
        raise ValueError(f"no local header of {m.name}")
    n, extra = struct.unpack_from("<HH", h, 26)
    if m.method:
        raise ValueError(f"{m.name} is compressed; only stored members can be range-read")
    return m.header + 30 + n + extra


class _Window:
    """Bytes of a range of a file, in order: read READ at a time, handed out PIECE at a time."""

    def __init__(self, f, start: int, size: int):
        self.f, self.at, self.end = f, start, start + size
        self.held, self.used = memoryview(b""), 0

    def piece(self) -> bytes:
        if self.used == len(self.held):
            n = min(READ, self.end - self.at)
            self.held, self.used = memoryview(self.f.read_at(n, self.at) if n > 0 else b""), 0
            self.at += len(self.held)
        out = bytes(self.held[self.used : self.used + PIECE])
        self.used += len(out)
        return out


def _index_lines(f, m: Member) -> Iterator[str]:
    """Lines of an index, gzip or plain, however long it is."""
    w, unzip, rest = _Window(f, data_start(f, m), m.size), None, b""
    while piece := w.piece():
        if m.name.endswith(".gz"):
            plain = b""
            while piece:
                unzip = unzip or zlib.decompressobj(31)
                plain += unzip.decompress(piece)
                piece, unzip = (unzip.unused_data, None) if unzip.eof else (b"", unzip)
        else:
            plain = piece
        *whole, rest = (rest + plain).split(b"\n")
        yield from (x.decode() for x in whole)
    yield rest.decode()


def _entries(f, members: list[Member]) -> Iterator[tuple[Member, int, int, bool]]:
    """(member, offset, length, whether it is one record) by the indexes; without any, each member as a whole."""
    archives = {m.name: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    indexes = [m for m in members if m.name.startswith("indexes/") and m.name.endswith((".cdxj", ".cdxj.gz"))]
    if not indexes:
        yield from ((m, 0, m.size, False) for m in archives.values())
        return
    for m in indexes:
        for line in _index_lines(f, m):
            if line.strip() and not line.startswith("!"):
                e = json.loads(line.split(" ", 2)[2])
                member = archives.get("archive/" + e["filename"])
                if member is None:
                    raise ValueError(f"{m.name} names {e['filename']}, which the archive does not have")
                if int(e["offset"]) + int(e["length"]) > member.size:
                    raise ValueError(f"{m.name} names a record behind the end of {e['filename']}")
                yield member, int(e["offset"]), int(e["length"]), True


def _unpacked(w: _Window) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record in a range, gzip members or plain. One record is held at a time."""
    at, held = 0, w.piece()
    while held:
        while len(held) < 2 and (more := w.piece()):
            held += more
        if held[:2] == b"\x1f\x8b":
            z, parts, used = zlib.decompressobj(31), [], 0
            while True:
                parts.append(z.decompress(held))
                used += len(held) - len(z.unused_data)
                if z.eof:
                    break
                if not (held := w.piece()):
                    raise ValueError("a record is cut off")
            held, plain = z.unused_data, b"".join(parts)
        else:
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not (more := w.piece()):
                    raise ValueError("no WARC record here" if at == 0 else "a record is cut off")
                held += more
            lengths = [int(x.partition(b":")[2]) for x in held[:end].split(b"\r\n") if x.lower().startswith(b"content-length:")]
            if not lengths:
                raise ValueError("a record without a length")
            used, parts, n = end + 4 + lengths[0] + 4, [held], len(held)
            while n < used and (more := w.piece()):
                parts.append(more)
                n += len(more)
            if n < used - 4:
                raise ValueError("a record is cut off")
            held = b"".join(parts)
            used = min(used, len(held))
            plain, held = held[:used], held[used:]
        yield at, used, plain
        at += used
        held = held or w.piece()


def _runs(entries: Iterable[tuple[int, int]], gap: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of ranges that touch, put together up to `gap` bytes; entries are sorted, repeats count once."""
    start = end = None
    for offset, length in entries:
        if start is not None and offset == end and end + length - start <= gap:
            end += length
        elif start is None or offset >= end:
            if start is not None:
                yield start, end - start
            start, end = offset, offset + length
    if start is not None:
        yield start, end - start


def read_archive(fs: pafs.FileSystem, at: str, gap: int = 1 << 20) -> Iterator[tuple[str, int, int, dict]]:
    """(member, offset, length, fields) of every record; ranges that touch are read together, up to `gap` bytes."""
    with fs.open_input_file(at) as f:
        entries = sorted(_entries(f, directory(f, f.size())), key=lambda e: (e[0].header, e[1]))
        for m, own in groupby(entries, lambda e: e[0]):
            start = data_start(f, m)
            for offset, length in _runs((e[1:3] for e in own), gap):
                for o, used, plain in _unpacked(_Window(f, start + offset, length)):
                    yield m.name, offset + o, used, parse_record(plain)


# ---- on the cluster


class _Writer:
    """Archives of one task, each written whole once it is full."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.reset()

    def reset(self) -> None:
        self.members: list[list[bytes]] = [[]]
        self.index: list[str] = []
        self.sizes = [0]

    def add(self, raw: bytes, uri: str, digest: str) -> None:
        if self.sizes[-1] >= MEMBER_BYTES:
            self.members.append([])
            self.sizes.append(0)
        name = f"data-{len(self.members) - 1:04d}.warc.gz"
        self.index.append(f"{uri} {DATE[:19].translate({45: None, 58: None, 84: None})} " + json.dumps({"filename": name, "offset": str(self.sizes[-1]), "length": str(len(raw)), "digest": "sha256:" + digest}))
        self.members[-1].append(raw)
        self.sizes[-1] += len(raw)

    def close(self) -> tuple[str, int] | None:
        if not self.index:
            return None
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
            for k, parts in enumerate(self.members):
                z.writestr(f"archive/data-{k:04d}.warc.gz", b"".join(parts))
            z.writestr("indexes/index.cdxj", "\n".join(sorted(self.index)) + "\n")
        path, n = f"{self.folder}/{uuid.uuid4().hex}.wacz", len(self.index)
        with self.fs.open_output_stream(path) as out:
            out.write(held.getbuffer())
        self.reset()
        return path, n


def _record_id(value) -> str:
    return f"urn:page:{value}" if value is not None else f"urn:uuid:{uuid.uuid4()}"


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_revisit: int = 100) -> DataFrame:
    """Writes a record for each row into archives below folder; returns their manifest: path, records.

    A task that runs again writes archives under new names, and only those of the run that counted are in
    the manifest, which is a written table.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("html"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("bigint").alias("size"))
    # a payload of a third of all rows is one row after the map side; with a table on the
    # other side the join has plain exchanges, and AQE splits its key where it is hot
    same = pages.select(F.col(page_id).alias("page_id"), text.alias("html")).filter((F.octet_length("html") >= least_revisit) & F.col("page_id").isNotNull())
    same = same.groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("digest_")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = table(same, "repeated")
    rows = rows.join(same, (F.col("digest") == F.col("digest_")) & (F.col("size") >= least_revisit), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, out, done = _Writer(folder), arrow_schema("path string, records bigint"), []
        w.fs.create_dir(w.folder, recursive=True)
        for b in batches:
            for r in b.to_pylist():
                payload = r["html"].encode("utf-8", "surrogatepass")
                revisit = r["first"] is not None and r["page_id"] is not None and r["page_id"] != r["first"]
                uri = (r["url"] or "urn:none").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
                w.add(record("revisit" if revisit else "response", _record_id(r["page_id"]), uri, payload, r["digest"], r["size"], _record_id(r["first"]) if revisit else None), uri, r["digest"])
                if sum(w.sizes) >= ARCHIVE_BYTES:
                    done.append(w.close())
        done.append(w.close())
        done = [d for d in done if d]
        yield batch(out, path=[p for p, _ in done], records=[n for _, n in done])

    return table(rows.mapInArrow(run, "path string, records bigint"), "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str, gap: int = 1 << 20) -> DataFrame:
    """Every record of the archives named in manifest (path), payloads included (see RECORDS).

    Directories and indexes are read first, a row for each record; then the records of a span of SPAN bytes of a member
    are one task's work, so an archive of any size is read by many. A member that no index describes has no marks to
    start from, and is streamed by one task. An archive that is broken or has a compressed member is an error that
    names it.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema("path string, member string, start bigint, offset bigint, length bigint, known boolean")
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                held: list[tuple] = []
                with _naming(path), fs.open_input_file(path) as f:
                    starts: dict[Member, int] = {}
                    for m, offset, length, known in _entries(f, directory(f, f.size())):
                        if m not in starts:
                            starts[m] = data_start(f, m)
                        held.append((path, m.name, starts[m], offset, length, known))
                        if len(held) == 10_000:
                            yield batch(out, **dict(zip(out.names, zip(*held, strict=True), strict=True)))
                            held = []
                if held:
                    yield batch(out, **dict(zip(out.names, zip(*held, strict=True), strict=True)))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(RECORDS)
        fs, _ = pafs.FileSystem.from_uri(folder)
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held, size = [], 0
        for (path, member, start, _), own in groupby(each, lambda r: r[:4]):
            with _naming(path), fs.open_input_file(path) as f:
                for offset, length in _runs((r[4:6] for r in own), gap):
                    for o, used, plain in _unpacked(_Window(f, start + offset, length)):
                        fields = parse_record(plain)
                        held.append({"path": path, "member": member, "offset": offset + o, "length": used} | fields)
                        size += len(fields["payload"])
                        if size >= 8 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=out)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = F.when(F.col("known"), F.floor(F.col("offset") / SPAN)).otherwise(0)
    paths = manifest.select("path").distinct().repartition(n, F.xxhash64("path"))
    spans = paths.mapInArrow(listed, "path string, member string, start bigint, offset bigint, length bigint, known boolean")
    spans = spans.select("path", "member", "start", span.alias("span"), "offset", "length").repartition(n, "path", "member", "span")
    return spans.sortWithinPartitions("path", "member", "start", "span", "offset").mapInArrow(records, RECORDS)


@contextmanager
def _naming(path: str):
    """Errors of a broken archive name it."""
    try:
        yield
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"{path}: {e}") from e


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back: the records of read()."""
    folder = scratch(pages.sparkSession, "archives")
    return read(pages.sparkSession, write(pages, folder), folder)


def sha256_hex(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""
