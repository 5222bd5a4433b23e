"""Media columns: images in archives, read by a Spark data source of our own.

Payloads are stored as 8-bit grey PNG images, 64 samples a row, in ZIP archives without
further compression, one archive a task. The data source plans byte ranges: the driver
reads each archive's end record only and cuts its payload area into ranges of a fixed
size; a task reads the archive's directory, takes the members that begin in its range
and streams them as Arrow batches. A member that can't be read or whose checksum is wrong
is read again by its own offset, without the others.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkloom.llm import common, encoding, storage

ROW = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of 64, and the unpadded size."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """Grey 8-bit image of the payload; the unpadded size is a text entry."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((rows.shape[0], ROW + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, rows.shape[0], 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded size of an image written by :func:`to_png`."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("no PNG")
    at, data, shape, n_bytes = 8, [], (0, 0), -1
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            n_bytes = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes(), n_bytes


def feature_of(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the image."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    edges = (np.arange(8) * image.shape[0]) // 8
    bands = np.add.reduceat(image.astype(np.int64), edges, axis=0)
    height = np.diff(np.append(edges, image.shape[0])).clip(1)
    blocks = bands.reshape(8, 8, 8).sum(axis=2) / (8 * height[:, None])
    bits = np.packbits(blocks.ravel() > blocks.mean())
    return f"{image.mean():.3f}:{image.std():.3f}:{bits.tobytes().hex()}"


class _Tell:
    """What zipfile needs of an output stream."""

    def __init__(self, file: storage.AtomicFile):
        self.file = file

    def write(self, data) -> int:
        self.file.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(docs: DataFrame, folder: str, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an image; returns (archive, members). Null texts are empty;
    every row is kept under its place and id, so repeated and null ids are too."""
    storage.make_dir(folder)

    def run(batches):
        part, members, file = TaskContext.get().partitionId(), 0, None
        for batch in encoding.slices(batches, "text", BATCH_BYTES):
            if file is None:
                file = storage.AtomicFile(f"{folder}/media-{part:06d}.zip")
                archive = zipfile.ZipFile(_Tell(file), "w", zipfile.ZIP_STORED, allowZip64=True)
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                archive.writestr(zipfile.ZipInfo(f"{members:09d}_{'null' if doc is None else doc}.png"), to_png(*payload_of(t)))
                members += 1
        if file:
            archive.close()
            file.commit()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/media-{part:06d}.zip"], "members": pa.array([members], pa.int64())})

    rows = docs.select(F.col(by).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return common.cut(rows.mapInArrow(run, "archive string, members long"), "media")


class ByteRange(InputPartition):
    """Members of an archive that begin at ``lo`` or later and before ``hi``."""

    def __init__(self, path: str, lo: int, hi: int, directory: int, directory_size: int):
        self.path, self.lo, self.hi = path, lo, hi
        self.directory, self.directory_size = directory, directory_size


def end_record(read, size: int) -> tuple[int, int]:
    """Offset and size of an archive's directory, from its last bytes."""
    span = min(size, 66_000)
    tail = read(size - span, span)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no archive end record")
    length, offset = struct.unpack_from("<II", tail, at + 12)
    if 0xFFFFFFFF in (length, offset) or tail[at + 8 : at + 10] == b"\xff\xff":
        locator = at - 20
        if tail[locator : locator + 4] != LOCATOR:
            raise ValueError("no large-archive locator")
        (record,) = struct.unpack_from("<Q", tail, locator + 8)
        length, offset = struct.unpack_from("<QQ", read(record, 56), 40)
    return offset, length


def directory_entries(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(name, header offset, size, crc32) of stored members."""
    at = 0
    while at + 46 <= len(data) and data[at : at + 4] == CENTRAL:
        method, _, _, crc, _, size, n, extra, comment = struct.unpack_from("<HHHIIIHHH", data, at + 10)
        (offset,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode()
        if 0xFFFFFFFF in (size, offset):
            more, spot = data[at + 46 + n : at + 46 + n + extra], 0
            while spot + 4 <= len(more):
                kind, length = struct.unpack_from("<HH", more, spot)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", more, spot + 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    if offset == 0xFFFFFFFF:
                        offset = wide[-1]
                spot += 4 + length
        if method:
            raise ValueError(f"{name} is compressed by the archive")
        yield name, offset, size, crc
        at += 46 + n + extra + comment


class MediaReader(DataSourceReader):
    """Byte-range partitions and the streaming of their members."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[ByteRange]:
        found = []
        for path, size in storage.list_files(self.folder, ".zip"):
            directory, length = end_record(lambda at, n, p=path: storage.read_range(p, at, n), size)
            for lo in range(0, directory, self.range_bytes):
                found.append(ByteRange(path, lo, min(lo + self.range_bytes, directory), directory, length))
        return found or [ByteRange("", 0, 0, 0, 0)]  # Spark wants one partition at least

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, path = storage.resolve(part.path)
        with fs.open_input_file(path) as file:
            rows, held = [], 0
            members = directory_entries(file.read_at(part.directory_size, part.directory))
            for name, offset, size, crc in members:
                if part.lo <= offset < part.hi:
                    rows.append((part.path, name, offset, member_bytes(file, offset, size, crc)))
                    held += size
                    if held >= BATCH_BYTES:
                        yield media_batch(rows)
                        rows, held = [], 0
            if rows:
                yield media_batch(rows)


def member_bytes(file, offset: int, size: int, crc: int, attempts: int = ATTEMPTS, wait: float = 0.2) -> bytes:
    """One member by its offset, read anew up to ``attempts`` times."""
    for attempt in range(attempts):
        try:
            head = file.read_at(30 + size + 512, offset)  # name and extra field included, as a rule
            if head[:4] != LOCAL:
                raise ValueError("no member header")
            n, extra = struct.unpack_from("<HH", head, 26)
            data = head[30 + n + extra : 30 + n + extra + size]
            if len(data) < size:
                data = file.read_at(size, offset + 30 + n + extra)
            if zlib.crc32(data) != crc:
                raise ValueError("wrong checksum")
            return data
        except (OSError, ValueError):
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


def media_batch(rows: list[tuple]) -> pa.RecordBatch:
    archive, member, offset, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(archive), pa.array(member), pa.array(offset, pa.int64()), pa.array(media, pa.binary())], ["archive", "member", "offset", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored images, from their bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload, n_bytes = from_png(data)
                doc = name.split("_")[1].removesuffix(".png")
                rows.append((None if doc == "null" else int(doc), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = [f.split(" ")[0] for f in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("member", "media").mapInArrow(run, FEATURES)


def store_and_read(docs: DataFrame, folder: str) -> DataFrame:
    """Write all texts as media and compute their features from what is read back. An
    empty table makes no archive and gives no rows."""
    spark = docs.sparkSession
    write_archives(docs, folder)
    spark.dataSource.register(MediaArchives)
    return features(spark.read.format("media_archives").load(folder))


def op7_media(spark, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All documents through the media column."""
    return store_and_read(common.documents(spark, sf_dir), folder or common.fresh_path(spark, "media"))
