"""Sequence packing over the length histogram, shortest pack first.

Documents are tokenized once; what follows works on lengths. The histogram has at most
``capacity`` rows whatever the corpus, so patterns are planned on the driver: lengths
come longest first, each goes into the pack that is shortest so far, and packs of one
shape are one pattern with a count. Pieces then get a rank within their length (a count
per task and length, summed over earlier tasks) and the rank finds the pattern's copy.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm import common, encoding

CAPACITY = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns as (number of sequences, lengths in each). Every length is at most the
    capacity; lengths of 0 or less take no part."""
    open_packs: dict[int, list[tuple[int, tuple | None]]] = {}
    spaces: list[int] = []  # negated free space, a heap with one entry per open space

    def put(space: int, count: int, chain: tuple) -> None:
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((count, chain))

    for length in sorted((k for k, n in histogram.items() if k > 0 and n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"length {length} is over the capacity {capacity}")
        left = histogram[length]
        while left and spaces and -spaces[0] >= length:
            space = -spaces[0]
            count, chain = open_packs[space].pop()
            used = min(count, left)
            if used < count:
                open_packs[space].append((count - used, chain))
            elif not open_packs[space]:
                del open_packs[space]
                heapq.heappop(spaces)
            put(space - length, used, (length, chain))
            left -= used
        if left:
            put(capacity - length, left, (length, None))
    patterns = []
    for space in sorted(open_packs):
        for count, chain in open_packs[space]:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            patterns.append((count, lengths[::-1]))
    return patterns


class Slots:
    """For each length, which sequence and offset its r-th piece gets."""

    def __init__(self, patterns: list[tuple[int, list[int]]], capacity: int):
        rows, first = [], 0
        for count, lengths in patterns:
            at = 0
            for length in lengths:
                rows.append((length, first, at, count))
                at += length
            first += count
        grid = np.array(sorted(rows), np.int64).reshape(-1, 4)
        length, self.first, self.offset, count = grid.T
        upto = np.cumsum(count) - count
        self.begin = np.searchsorted(length, np.arange(capacity + 2))
        zero = np.append(upto, 0)[np.minimum(self.begin, upto.size)]
        self.base = zero  # pieces of shorter lengths
        self.upto = upto
        self.sequences = first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        global_rank = self.base[length] + rank
        at = np.searchsorted(self.upto, global_rank, "right") - 1
        return self.first[at] + global_rank - self.upto[at], self.offset[at]


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = CAPACITY, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: whole ones from the start, then the rest.

    Null texts are empty: they have the end id only. Every row is kept.
    """

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in encoding.slices(batches, "text"):
            ids, bounds = encoding.encoder(vocabulary, end_id).encode(batch.column("text").to_pylist())
            tokens = np.diff(bounds)
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(tokens.size), pieces)
            start = (np.arange(doc.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(tokens[doc] - start, capacity)
            raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (bounds[doc] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            run_start = np.searchsorted(length[order], length[order])
            rank = np.empty(doc.size, np.int64)
            rank[order] = np.arange(doc.size) - run_start
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(np.full(doc.size, part, np.int32)), pa.array(rank)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"],
            )

    rows = docs.select(F.col(by).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset.

    ``pieces`` is a written table with part, length and local_rank (0, 1, ... within each
    part and length). The histogram, at most ``capacity`` rows, is all the driver gets.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = common.cut(counts.withColumn("before", F.coalesce(earlier, F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(Slots(plan(histogram, capacity), capacity))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                length = batch.column("length").to_numpy()
                sequence, offset = slots.value.place(length, batch.column("rank").to_numpy())
                keep = [n for n in batch.schema.names if n != "rank"]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], keep + ["sequence_id", "offset"])

    ranked = pieces.join(counts.select("part", "length", "before").hint("merge"), ["part", "length"])  # grows with the tasks: no broadcast
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: one row per piece. An empty table gives no pieces; ties in
    length are ordered by place in the input's partitions."""
    return assign(common.cut(cut_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)


def op5_packing(spark, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack(common.documents(spark, sf_dir), common.tokenizer_path(vocabulary))
