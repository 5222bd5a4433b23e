import hashlib
import io
import zipfile
import zlib

import pytest

from sparkloom.llm import common, media


def test_png_round_trip():
    for text in (None, "", "a", "x" * 64, "é" * 1000, "日本語😀"):
        payload, n = media.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n].decode() == (text or "")
        assert media.from_png(media.to_png(payload, n)) == (payload, n)
    damaged = bytearray(media.to_png(*media.payload_of("hello")))
    damaged[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(damaged))


def test_directory_is_that_of_zipfile(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k in range(50):
            z.writestr(f"m{k}", bytes([k]) * (k + 1))
    raw = data.getvalue()
    at, size = media.end_record(lambda o, n: raw[o : o + n], len(raw))
    found = list(media.directory_entries(raw[at : at + size]))
    assert [(i.filename, i.header_offset, i.file_size, i.CRC) for i in zipfile.ZipFile(data).infolist()] == found


class Flaky(io.BytesIO):
    """Fails a few times, then reads."""

    def __init__(self, data, failures):
        super().__init__(data)
        self.failures = failures

    def read_at(self, n, offset):
        if self.failures:
            self.failures -= 1
            raise OSError("lost")
        self.seek(offset)
        return self.read(n)


def test_members_are_retried_by_offset():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a", b"payload")
    assert media.member_bytes(Flaky(data.getvalue(), 2), 0, 7, zlib.crc32(b"payload"), wait=0) == b"payload"
    with pytest.raises(OSError):
        media.member_bytes(Flaky(data.getvalue(), 3), 0, 7, zlib.crc32(b"payload"), wait=0)
    with pytest.raises(ValueError):
        media.member_bytes(Flaky(data.getvalue(), 0), 0, 7, 1, wait=0)


def check(df, folder):
    got = sorted((tuple(r) for r in media.store_and_read(df, folder).collect()), key=repr)
    want = []
    for r in df.collect():
        payload, n = media.payload_of(r["text"])
        stored = media.to_png(payload, n)
        want.append((r["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(payload)))
    assert got == sorted(want, key=repr)


def test_odd_rows_and_the_table(spark, odd, docs):
    check(odd, common.fresh_path(spark, "m"))
    check(docs, common.fresh_path(spark, "m"))


def test_small_ranges_read_every_member_once(spark, docs):
    folder = common.fresh_path(spark, "m")
    media.write_archives(docs.coalesce(1), folder)
    spark.dataSource.register(media.MediaArchives)
    rows = spark.read.format("media_archives").option("rangeBytes", "20000").load(folder)
    assert rows.rdd.getNumPartitions() > 3
    assert rows.count() == docs.count() == rows.select("member").distinct().count()


def test_empty_table(spark, none):
    assert media.store_and_read(none, common.fresh_path(spark, "m")).count() == 0
