"""WARC archives in Zstandard, one frame for each record.

An archive begins with a skippable frame that holds the dictionary its records are
compressed with (itself compressed); an archive of a few records has none. A payload that
occurs again is stored once: the other records of the group are revisits, which hold the
HTTP headers and name the record to look at. The reader loads the dictionary, decodes frame
by frame as the bytes come, and checks each record's version, header fields, lengths and
digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common, storage

# The format's marks.
FRAME, DICTIONARY_FRAME, SKIPPABLE = b"\x28\xb5\x2f\xfd", 0x184D2A5D, 0x184D2A50
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 1_000
#: An archive's size past which the next one begins; its dictionary, and the bytes of first
#: records that this is trained on (the dictionary changes sizes alone, never records).
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 256_000_000, 32_768, 1_000_000
LEVEL = 3
READ_BYTES = 1_000_000
DATE = "2020-01-01T00:00:00Z"
#: Groups with this share of the rows and more are sent to every task: at most so many.
HOT_GROUPS = 1_000


def record_id(page: int | None, shard: int, place: int) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:page:none-{shard}-{place}>"


def to_record(rid: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None, date: str = DATE) -> bytes:
    """One record; a revisit's block ends after the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url)]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Holds the first records until the dictionary is trained, then streams."""

    def __init__(self, uri: str):
        self.file, self.press = storage.AtomicFile(uri), None
        self.held: list[bytes] = []
        self.waiting = self.records = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.press is None:
            self.held.append(record)
            self.waiting += len(record)
            if self.waiting >= SAMPLE_BYTES:
                self.start()
        else:
            self.file.write(self.press.compress(record))

    def start(self) -> None:
        options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
        try:
            known = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:100_000] for r in self.held], k=256, d=8)
        except zstandard.ZstdError:  # too few records to learn from
            self.press = zstandard.ZstdCompressor(**options)
        else:
            known.precompute_compress(level=LEVEL)
            packed = zstandard.ZstdCompressor(level=19).compress(known.as_bytes())
            self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            self.press = zstandard.ZstdCompressor(dict_data=known, **options)
        for record in self.held:
            self.file.write(self.press.compress(record))
        self.held = []

    def close(self) -> int:
        if self.press is None:
            self.start()
        self.file.commit()
        return self.file.size


def frames(uri: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame after the dictionary; memory is one frame's. Raises
    ValueError for bytes that are no frames."""
    fs, path = storage.resolve(uri)
    with fs.open_input_stream(path, compression=None) as f:
        rest, at, press, ended = b"", 0, zstandard.ZstdDecompressor(), False

        def more(need: int) -> bytes:
            nonlocal ended
            got = rest
            while len(got) < need and not ended:
                new = f.read(max(READ_BYTES, need - len(got)))
                ended, got = not new, got + new
            return got

        while True:
            rest = more(8)
            if not rest:
                return
            magic, size = struct.unpack("<II", rest[:8]) if len(rest) >= 8 else (0, 0)
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                rest = more(8 + size)
                if len(rest) < 8 + size:
                    raise ValueError(f"{uri}: cut off at {at}")
                if magic == DICTIONARY_FRAME and at == 0:
                    known = rest[8 : 8 + size]
                    known = zstandard.ZstdDecompressor().decompress(known) if known[:4] == FRAME else known
                    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
                rest, at = rest[8 + size :], at + 8 + size
                continue
            if rest[:4] != FRAME:
                raise ValueError(f"{uri}: no frame at {at}")
            one, out, used = press.decompressobj(), [], 0
            try:
                while not one.eof:
                    rest = rest or more(1)
                    if not rest:
                        raise ValueError(f"{uri}: cut off at {at}")
                    out.append(one.decompress(rest))
                    used += len(rest)
                    rest = b""
            except zstandard.ZstdError as e:
                raise ValueError(f"{uri}: damaged frame at {at}: {e}") from e
            rest = one.unused_data
            yield at, b"".join(out)
            at += used - len(rest)


def header_fields(head: bytes) -> dict[str, str]:
    """Lower-case names and values of header lines; a line that begins with a blank
    continues the one before."""
    found: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = value.strip()
    return found


@dataclass
class Record:
    record_id: str | None = None
    record_type: str | None = None
    uri: str | None = None
    date: str | None = None
    refers_to: str | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None
    problem: str | None = None


def from_record(data: bytes) -> Record:
    """A frame's record; ``problem`` says what is wrong with it, if anything is."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    field = header_fields(lines)
    kind, rid = field.get("warc-type"), field.get("warc-record-id")
    out = Record(rid, kind, field.get("warc-target-uri"), field.get("warc-date"), field.get("warc-refers-to"))

    def wrong(what: str) -> Record:
        out.problem = what
        return out

    if version not in VERSIONS or not gap:
        return wrong("no version line or header")
    lost = [n for n in NEEDED if not field.get(n)]
    if lost:
        return wrong(f"no {lost[0]}")
    if not re.fullmatch(r"[0-9]+", field["content-length"]):
        return wrong("content-length is no number")
    size = int(field["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return wrong(f"block of {len(rest) - 4} bytes for a content-length of {size}")
    block = rest[:size]
    told = field.get("warc-payload-digest", "")
    if kind not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    length = header_fields(lines).get("content-length", "")
    if not status.startswith(b"HTTP/") or not gap:
        return wrong("no HTTP header")
    if kind == "revisit":
        if not told.startswith("sha1:") or not out.refers_to or not field.get("warc-profile", "").endswith("identical-payload-digest"):
            return wrong("revisit without digest, target or profile")
        if not length.isdigit() or payload:
            return wrong("revisit without a length, or with a payload")
        out.payload_bytes = int(length)
        try:
            out.payload_digest = base64.b32decode(told[5:]).hex()
        except ValueError:
            return wrong("digest is not base 32")
        return out
    out.payload, out.payload_bytes, out.payload_digest = payload, len(payload), hashlib.sha1(payload).hexdigest()
    if length and length != str(len(payload)):
        return wrong(f"payload of {len(payload)} bytes for an HTTP length of {length}")
    if told and told != "sha1:" + base64.b32encode(bytes.fromhex(out.payload_digest)).decode():
        return wrong("payload has another digest")
    return out


# ---- tables


def marked(pages: DataFrame, by: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, target): target is the largest id of the rows
    with that payload, where it is of ``REVISIT_BYTES`` and more, occurs again and this row
    isn't it.

    Groups are counted without payloads. The few that hold a thousandth of the rows or more
    are sent to every task, so no other group that a join may gather is larger.
    """
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(by).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.cast("binary").alias("payload"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    counted = rows.select("page_id", "digest", "size").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"), F.first("size").alias("of"))
    groups = common.cut(counted.where((F.col("n") > 1) & (F.col("of") >= REVISIT_BYTES) & F.col("last").isNotNull()).select("digest", "last", "n"), "groups")
    least = -(-pages.count() // HOT_GROUPS)
    hot = groups.where(F.col("n") >= least).select("digest", F.col("last").alias("hot"))
    light = groups.where(F.col("n") < least).select("digest", F.col("last").alias("light"))
    met = rows.join(F.broadcast(hot), "digest", "left")
    # a hot row looks for nothing, and rows that look for nothing don't go to one task
    key = F.when(F.col("hot").isNull() & (F.col("size") >= REVISIT_BYTES), F.col("digest")).otherwise(F.concat_ws(":", F.lit("none"), F.monotonically_increasing_id()))
    met = met.withColumn("key", key).join(light.withColumnRenamed("digest", "key"), "key", "left")
    last = F.coalesce("hot", "light")
    return met.select("page_id", "url", "payload", "digest", "size", F.when(F.col("page_id").isNull() | (F.col("page_id") != last), last).alias("target"))


def write_archives(pages: DataFrame, folder: str, by: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A record for each row of ``pages`` in archives of the folder; returns the manifest
    (path, records, bytes).

    Null texts are empty payloads. Of rows with equal payloads of ``REVISIT_BYTES`` and more
    those with the largest id are responses, the others revisit it; if all ids are null, all
    are responses. Repeated ids have records each, under one record id; null ids are
    numbered by archive. A null address becomes the record's own. An empty table writes
    nothing. Other columns are ignored.
    """
    storage.make_dir(folder)
    safe = "!#$%&'()*+,/:;=?@[]~"

    def write(batches):
        shard, k, out, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for page, address, payload, digest, size, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "target")), strict=True):
                if out is None:
                    path = f"{folder}/pages-{shard:06d}-{k:04d}.warc.zst"
                    out = ArchiveWriter(path)
                rid = record_id(page, shard, out.records)
                out.add(to_record(rid, quote(address, safe) if address else rid[1:-1], payload, digest, size, None if target is None else record_id(target, 0, 0)))
                if out.file.size >= archive_bytes:
                    done.append((path, out.records, out.close()))
                    out, k = None, k + 1
        if out is not None:
            done.append((path, out.records, out.close()))
        for row in done:
            yield pa.RecordBatch.from_pydict({"path": [row[0]], "records": [row[1]], "bytes": [row[2]]})

    return common.cut(marked(pages, by, url, html).mapInArrow(write, "path string, records long, bytes long"), "archives")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of a folder's archives."""
    return spark.createDataFrame(storage.list_files(folder, ".warc.zst"), "path string, bytes long")


def read_archives(paths: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """(path, offset, record_id, record_type, uri, date, refers_to, payload_bytes,
    payload_digest, payload, problem) of every record of the archives, a task for an archive.

    ``payload_bytes`` and ``payload_digest`` (hex) are the full payload's, of revisits too,
    from their own headers. A record that fails a check raises, or with ``strict`` off has a
    ``problem``; bytes that are no frame always raise. ``payloads`` off leaves them out.
    """
    names = ["record_id", "record_type", "uri", "date", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payloads else []), "problem"]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = "path string, offset long, " + ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names)

    def batch_of(path: str, rows: list) -> pa.RecordBatch:
        cells = [pa.array([getattr(r, n) for _, r in rows], kinds.get(n, pa.string())) for n in names]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), *cells], ["path", "offset", *names])

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for at, data in frames(path):
                    record = from_record(data)
                    if strict and record.problem:
                        raise ValueError(f"{path}: record at {at}: {record.problem}")
                    if not payloads:
                        record.payload = None
                    rows.append((at, record))
                    size += 500 + len(record.payload or b"")
                    if size > common.BATCH_BYTES:
                        yield batch_of(path, rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(path, rows)

    dealt = paths.select("path").repartition(common.shuffle_parts(paths.sparkSession), F.xxhash64("path"))
    return dealt.mapInArrow(read, schema)


def dangling(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits whose response isn't there with that digest."""
    asked = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    there = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest").distinct()
    return asked.join(there, ["refers_to", "payload_digest"], "left_anti")


def op11_warc(spark, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All pages written as WARC records and read back."""
    written = write_archives(common.table(spark, sf_dir, "pages"), folder or common.fresh_path(spark, "warc"))
    found = read_archives(written, payloads=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as long)")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP11_SQL = """WITH p AS (SELECT page_id::BIGINT AS page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY h),
r AS (SELECT d.*, CASE WHEN page_id IS NULL OR page_id <> last THEN last END AS target FROM d LEFT JOIN g USING (h))
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN target IS NULL THEN 'response' ELSE 'revisit' END AS record_type, target AS refers_to FROM r"""
