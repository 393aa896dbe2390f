"""Archives from elsewhere: with and without an index, broken, long; spans of one archive by several tasks."""

import gzip
import json
import zipfile

import pytest
from lodestone.llm import warc
from pyarrow import fs as pafs


def plain(i, body=b""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (i, len(block)) + block + b"\r\n\r\n"


def archive(at, records, index=True, packed=True, zipped_index=False, twice=False, name="data.warc.gz", lie=None, method=zipfile.ZIP_STORED):
    raw, lines = b"", []
    for i, r in enumerate(records):
        r = gzip.compress(r) if packed else r
        lines.append(f"com,x)/{999 - i} 2024 " + json.dumps({"filename": lie or name, "offset": str(len(raw)), "length": str(len(r))}))
        raw += r
    with zipfile.ZipFile(at, "w", method) as z:
        z.writestr(f"archive/{name}", raw)
        if index:
            text = ("!meta {}\n" + "\n".join(sorted(lines * (1 + twice))) + "\n").encode()
            z.writestr("indexes/index.cdxj" + ".gz" * zipped_index, gzip.compress(text[:100]) + gzip.compress(text[100:]) if zipped_index else text)
    return str(at)


BODIES = [b"", b"x", b"y" * 70_000, b"\r\n\r\n", bytes(range(256)) * 40] + [b"z%d" % i for i in range(300)]


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("piece", [7, 64 << 10])
def test_records_of_one_archive(tmp_path, monkeypatch, index, packed, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    at = archive(tmp_path / "a.wacz", [plain(i, b) for i, b in enumerate(BODIES)], index, packed, zipped_index=True, twice=True)
    got = list(warc.read_archive(pafs.LocalFileSystem(), at, gap=3000))
    assert sorted((int(f["record_id"].rpartition(":")[2]), f["payload"]) for *_, f in got) == list(enumerate(BODIES))


def test_spans_of_one_archive(spark, tmp_path, monkeypatch):
    at = archive(tmp_path / "a.wacz", [plain(i, b) for i, b in enumerate(BODIES)])
    monkeypatch.setattr(warc, "SPAN", 500)
    manifest = spark.createDataFrame([(at,), (at,)], "path string")
    df = warc.read(spark, manifest, f"file://{tmp_path}")
    rows = df.collect()
    assert sorted((int(r["record_id"].rpartition(":")[2]), bytes(r["payload"])) for r in rows) == list(enumerate(BODIES))
    held = [n for n in df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
    assert len(held) > 1  # several tasks


def test_a_long_member_without_an_index(spark, tmp_path):
    n = 3000
    at = archive(tmp_path / "a.wacz", [plain(i, b"%d " % i * 300) for i in range(n)], index=False, packed=False)
    df = warc.read(spark, spark.createDataFrame([(at,)], "path string"), f"file://{tmp_path}")
    assert df.selectExpr("count(distinct record_id) n", "sum(octet_length(payload)) s").first()[:] == (n, sum(len(b"%d " % i * 300) for i in range(n)))


BROKEN = {
    "names other.warc.gz, which": lambda p: archive(p, [plain(1)], lie="other.warc.gz"),
    "compressed": lambda p: archive(p, [plain(1, b"a" * 999)], method=zipfile.ZIP_DEFLATED),
    "no end of central directory": lambda p: p.write_bytes(b"no archive " * 50) and str(p),
    "cut off": lambda p: archive(p, [plain(1, b"abc" * 99)[:-150]], index=False, packed=False),
    "cut off ": lambda p: archive(p, [gzip.compress(plain(1))[:-9]], index=False, packed=False),
    "no WARC record": lambda p: archive(p, [b"something else"], index=False, packed=False),
    "without a length": lambda p: archive(p, [b"WARC/1.1\r\n\r\nx"], index=False, packed=False),
}


@pytest.mark.parametrize("what", BROKEN)
def test_broken_archives_are_named(spark, tmp_path, what):
    at = BROKEN[what](tmp_path / "broken.wacz")
    with pytest.raises(ValueError, match=what.strip()):
        list(warc.read_archive(pafs.LocalFileSystem(), at))
    if what in ("compressed", "cut off"):
        with pytest.raises(Exception, match="broken.wacz: .*" + what):
            warc.read(spark, spark.createDataFrame([(at,)], "path string"), f"file://{tmp_path}").collect()


def test_an_archive_of_nothing(spark, tmp_path):
    at = archive(tmp_path / "a.wacz", [])
    assert warc.read(spark, spark.createDataFrame([(at,)], "path string"), f"file://{tmp_path}").count() == 0
