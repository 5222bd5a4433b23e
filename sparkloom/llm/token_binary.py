"""Token ids as compressed binary shards (bit-plane shuffling).

File format, all numbers little-endian::

    magic "LTOK1\\n\\0\\0"
    blocks of ids, each BLOCK_IDS unsigned 32-bit ids (the last fewer), stored as planes
    one table: doc_id int64s, null flags, token counts int64s - zstandard
    chunk index: one JSON object - zstandard
    footer: index offset int64, index size int64, crc32 of the index uint32, magic

A block is transposed into 4 byte planes or 32 bit planes; each plane is compressed with
zstandard by itself. The high planes are nearly constant and vanish; all-zero planes are
stored as nothing. The chunk index has each block's first id, size, crc32 and its planes'
offsets, so any id range is read without the rest.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm import common, encoding, storage

MAGIC = b"LTOK1\n\0\0"
FOOTER = struct.Struct("<qqI8s")
BLOCK_IDS = 65_536
LEVEL = 1


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids, lowest first."""
    grid = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [grid[:, k].tobytes() for k in range(4)]
    planes = np.unpackbits(grid, axis=1, bitorder="little")
    return [np.packbits(planes[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    if not bits:
        grid = np.empty((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            grid[:, k] = np.frombuffer(plane, np.uint8)
    else:
        cells = np.empty((count, 32), np.uint8)
        for k, plane in enumerate(planes):
            cells[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
        grid = np.packbits(cells, axis=1, bitorder="little")
    return np.ascontiguousarray(grid).view("<u4").reshape(-1)


class ShardWriter:
    """Streams documents' ids into one shard; memory is one block and the doc table."""

    def __init__(self, uri: str, bits: bool = False):
        self.file = storage.AtomicFile(uri)
        self.file.write(MAGIC)
        self.bits, self.press = bits, zstandard.ZstdCompressor(level=LEVEL)
        self.blocks: list[dict] = []
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.counts.append(counts.astype("<i8"))
        self.rest.append(ids)
        self.waiting += ids.size
        if self.waiting >= BLOCK_IDS:
            flat = np.concatenate(self.rest)
            whole = flat.size - flat.size % BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self.block(flat[at : at + BLOCK_IDS])
            self.rest, self.waiting = [flat[whole:].copy()], flat.size - whole

    def block(self, ids: np.ndarray) -> None:
        places = []
        for plane in to_planes(ids, self.bits):
            packed = self.press.compress(plane) if any(plane) else b""
            places.append([self.file.size, len(packed)])
            self.file.write(packed)
        self.blocks.append({"first": self.total, "n": int(ids.size), "crc": zlib.crc32(np.ascontiguousarray(ids, "<u4")), "planes": places})
        self.total += int(ids.size)

    def close(self) -> dict:
        if self.waiting:
            self.block(np.concatenate(self.rest))
        table = [np.concatenate(x) if x else np.zeros(0, np.uint8) for x in (self.docs, self.nulls, self.counts)]
        packed = self.press.compress(b"".join(x.tobytes() for x in table))
        at = self.file.size
        self.file.write(packed)
        index = self.press.compress(json.dumps({"bits": self.bits, "ids": self.total, "docs": int(table[0].size), "table": [at, len(packed)], "blocks": self.blocks}).encode())
        at = self.file.size
        self.file.write(index)
        self.file.write(FOOTER.pack(at, len(index), zlib.crc32(index), MAGIC))
        self.file.commit()
        return {"docs": int(table[0].size), "ids": self.total, "bytes": self.file.size}


class ShardReader:
    """Reads a shard through its chunk index, block by block."""

    def __init__(self, uri: str):
        self.fs, path = storage.resolve(uri)
        self.file = self.fs.open_input_file(path)
        at, length, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, self.file.size() - FOOTER.size))
        index = self.file.read_at(length, at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"damaged shard: {uri}")
        self.press = zstandard.ZstdDecompressor()
        self.index = json.loads(self.press.decompress(index))

    def doc_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, length = self.index["table"]
        data, n = self.press.decompress(self.file.read_at(length, at)), self.index["docs"]
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n), np.frombuffer(data, "<i8", n, 9 * n)

    def block(self, k: int) -> np.ndarray:
        b, bits = self.index["blocks"][k], self.index["bits"]
        size = (b["n"] + 7) // 8 if bits else b["n"]
        at = b["planes"][0][0]
        data = self.file.read_at(sum(n for _, n in b["planes"]), at)
        planes = [self.press.decompress(data[o - at : o - at + n]) if n else bytes(size) for o, n in b["planes"]]
        ids = from_planes(planes, b["n"], bits)
        if zlib.crc32(ids) != b["crc"]:
            raise ValueError(f"damaged block {k}")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Any range of the shard's ids."""
        parts = [self.block(k)[max(start - b["first"], 0) : stop - b["first"]] for k, b in enumerate(self.index["blocks"]) if b["first"] < stop and start < b["first"] + b["n"]]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self, group: int = 4_096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(doc_ids, null flags, counts, ids) of groups of documents, in file order."""
        docs, nulls, counts = self.doc_table()
        rest, k = np.zeros(0, np.uint32), 0
        for at in range(0, docs.size, group):
            need = int(counts[at : at + group].sum())
            parts, have = [rest], rest.size
            while have < need:
                parts.append(self.block(k))
                have += parts[-1].size
                k += 1
            flat = np.concatenate(parts)
            yield docs[at : at + group], nulls[at : at + group], counts[at : at + group], flat[:need]
            rest = flat[need:]


MANIFEST = "shard int, path string, docs long, ids long, bytes long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0, bits: bool = False, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending ``by`` order; returns the manifest.

    Null texts are empty, null ids come first, rows with equal ids are ordered by text,
    and all of them are kept. An empty table gives an empty manifest. Other columns are
    ignored, whatever their names.
    """
    storage.make_dir(folder)

    def write(batches):
        enc, writer, shard = encoding.encoder(vocabulary, end_id), None, TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.ltok"
        for batch in encoding.slices(batches, "text"):
            writer = writer or ShardWriter(path, bits)
            ids, bounds = enc.encode(batch.column("text").to_pylist())
            writer.add(batch.column("doc_id"), ids, np.diff(bounds))
        if writer:
            x = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "docs": [x["docs"]], "ids": [x["ids"]], "bytes": [x["bytes"]]})

    rows = docs.select(F.col(by).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return common.cut(dealt.mapInArrow(write, MANIFEST), "tokens")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32, and the shard it lies in."""
    spark = manifest.sparkSession
    # one row per shard: the sum over earlier shards is over a table of file names
    before = F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "path", before.alias("base")).repartition(common.shuffle_parts(spark))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = row["base"]
                for docs, nulls, counts, ids in ShardReader(row["path"]).documents():
                    upto = np.cumsum(counts)
                    first = upto - counts
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), upto.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64(), mask=nulls.astype(bool)), pa.array(first + at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(docs.size, row["shard"], np.int32))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )
                    at += int(upto[-1])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op2_token_binary(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Token ids of all documents written as shards and read back, with end id 0."""
    out = folder or common.fresh_path(spark, "shards")
    manifest = write_shards(common.documents(spark, sf_dir), out, common.tokenizer_path(vocabulary), 0)
    return read_shards(manifest)
