import hashlib
import struct
from collections import Counter

import pytest
import zstandard

from sparkloom.llm import queries, warc
from tests.oracle import spark_rows, sql_rows

LONG = "<html>" + "the same page again " * 80


def odd_pages():
    return [
        (1, "https://a.example/x", LONG),
        (2, "https://a.example/y z\r\nInjected: 1", LONG),
        (7, None, LONG),
        (7, None, LONG),
        (None, "https://b.example/", LONG),
        (3, "", None),
        (4, "https://c.example/é", ""),
        (5, "u", "short"),
        (6, "u", "short"),
        (8, "u", "ä" * 500),
        (9, "u", "ä" * 500),
        (10, "u", "b" * 999),
        (11, "u", "b" * 999),
        (None, "u", "n" * 2_000),
        (None, "u", "n" * 2_000),
        (12, "u", "WARC/1.1\r\n\r\n" * 300),
        (-3, "u", "line\r\n\r\n" * 100_000),
    ]


def plain(rows):
    """Expected (page, bytes, digest, type, target) of each row, in brute force."""
    cells = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in cells:
        last = max((q for q, c in cells if c == b and q is not None), default=None)
        again = len(b) >= 1_000 and last is not None and p != last
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return Counter(out)


@pytest.fixture(scope="module")
def odd_written(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}"
    df = spark.createDataFrame([(*r, 1, "x") for r in odd_pages()], "page_id long, url string, html string, target int, digest string").repartition(3)
    return folder, warc.write_archives(df, folder)


def test_odd_rows(odd_written):
    folder, manifest = odd_written
    got = warc.read_archives(manifest).collect()
    page = lambda rid: int(rid[10:-1]) if rid and "none" not in rid else None
    assert Counter((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got) == plain(odd_pages())
    assert all("\n" not in r["uri"] and r["uri"] for r in got)
    assert len({r["record_id"] for r in got if "none" in r["record_id"]}) == 3
    by = {page(r["record_id"]): r for r in got}
    assert by[7]["payload"] == LONG.encode() and by[1]["payload"] is None and by[4]["payload"] == b""
    assert manifest.agg({"records": "sum"}).first()[0] == len(odd_pages())
    assert warc.archives(manifest.sparkSession, folder).count() == manifest.count()
    assert warc.dangling(warc.read_archives(manifest)).count() == 0
    assert warc.dangling(warc.read_archives(manifest).where("record_id <> '<urn:page:7>'")).count() == 1


def test_hot_groups_are_sent_to_every_task(spark, monkeypatch, tmp_path):
    rows = [(i, "u", LONG if i % 3 else f"{i} {LONG}" if i % 2 else f"{i % 4} {LONG}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for groups in (2, 20):
        monkeypatch.setattr(warc, "HOT_GROUPS", groups)
        got = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/{groups}"), payloads=False).collect()
        page = lambda rid: int(rid[10:-1]) if rid else None
        assert Counter((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got) == plain(rows)


def test_whole_table_is_its_sql(spark, sf_dir):
    got, columns = spark_rows(queries.queries()["op11_warc"](spark, sf_dir))
    want, names = sql_rows(warc.OP11_SQL, sf_dir)
    assert columns == names and got == want


def test_archives_have_a_dictionary_and_a_frame_a_record(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 50_000)
    folder, payloads = f"file://{tmp_path}", [f"<p>{i}</p> some page of words {i * i} and more of them {i % 7} ".encode() * 40 for i in range(400)]
    out, files = None, []
    for i, b in enumerate(payloads):
        out = out or warc.ArchiveWriter(f"{folder}/{len(files)}.warc.zst")
        out.add(warc.to_record(f"<urn:page:{i}>", "https://x.example/", b, hashlib.sha1(b).hexdigest(), len(b), None))
    out.close()
    data = (tmp_path / "0.warc.zst").read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert len(known.as_bytes()) > 1_000 and zstandard.get_frame_parameters(data[8 + size :]).dict_id == known.dict_id()
    monkeypatch.setattr(warc, "READ_BYTES", 777)  # frames over the borders of what is read at once
    found = list(warc.frames(f"{folder}/0.warc.zst"))
    assert [warc.from_record(d).payload for _, d in found] == payloads
    at, last = found[-1]
    assert zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[at:]) == last
    # an uncompressed dictionary is read as well, and a skippable frame in between
    plain = known.as_bytes()
    note = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    (tmp_path / "1.warc.zst").write_bytes(struct.pack("<II", 0x184D2A5D, len(plain)) + plain + note + data[8 + size :])
    assert [d for _, d in warc.frames(f"{folder}/1.warc.zst")] == [d for _, d in found]


def test_many_archives_of_one_task(spark, tmp_path):
    noise = lambda i: "".join(hashlib.sha256(f"{i}:{k}".encode()).hexdigest() for k in range(400))
    rows = [(i, "u", noise(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}/many", archive_bytes=100_000)
    assert manifest.count() > 2 and manifest.agg({"records": "sum"}).first()[0] == 100
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest).collect()}
    assert got == {f"<urn:page:{i}>": t for i, _, t in rows}


def record(**change):
    b = b"payload"
    data = warc.to_record("<urn:page:1>", "u", b, hashlib.sha1(b).hexdigest(), len(b), None)
    for old, new in change.values():
        assert old in data
        data = data.replace(old, new)
    return data


@pytest.mark.parametrize(
    "old, new, problem",
    [
        (b"WARC/1.1\r\n", b"WARC/9\r\n", "version"),
        (b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b"", "warc-date"),
        (b"WARC-Record-ID: <urn:page:1>\r\n", b"", "warc-record-id"),
        (b"payload\r\n\r\n", b"payload and more\r\n\r\n", "block of"),
        (b"payload\r\n\r\n", b"payload", "block of"),
        (b"payload\r\n\r\n", b"pAyload\r\n\r\n", "another digest"),
        (b"text/html; charset=utf-8\r\nContent-Length: 7", b"text/html; charset=utf-8\r\nContent-Length: 8", "HTTP length"),
        (b"HTTP/1.1", b"XTTP/1.1", "HTTP header"),
    ],
)
def test_damaged_records(old, new, problem):
    assert warc.from_record(record()).problem is None
    assert problem in warc.from_record(record(x=(old, new))).problem


def test_damaged_archives(spark, tmp_path):
    bad = record(x=(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    press = zstandard.ZstdCompressor(write_checksum=True)
    (tmp_path / "bad.warc.zst").write_bytes(press.compress(record()) + press.compress(bad))
    paths = spark.createDataFrame([(f"file://{tmp_path}/bad.warc.zst",)], "path string")
    assert [r["problem"] for r in warc.read_archives(paths, strict=False).collect()] == [None, "payload has another digest"]
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(paths).collect()
    whole = press.compress(record())
    for name, data in (("cut", whole[:-3]), ("noise", whole + b"hello world"), ("flip", whole[:-1] + bytes([whole[-1] ^ 1]))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            list(warc.frames(f"file://{tmp_path}/{name}"))


def test_continued_header_lines():
    data = record(x=(b"WARC-Target-URI: u\r\n", b"WARC-Target-URI: u\r\n v\r\n"))
    assert warc.from_record(data).uri == "u v"
    assert warc.from_record(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n").problem is None


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, f"file://{tmp_path}/none")).count() == 0
