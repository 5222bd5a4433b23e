"""Importance resampling towards a target distribution.

Every document is scored by how much likelier its hashed word runs are in the target texts
than in the whole corpus, noise drawn from its id is added, and the highest scores are
drawn: a sample without replacement in proportion to the weights.

Long texts are skewed work, so they are chunked with an overlap: cut at word boundaries,
each chunk with the n-1 words that follow it. A chunk owns the runs that start in it, so
each run is counted once. Chunks are dealt over all tasks and written once; both passes read
them, and what they count is summed by document.

Counts of buckets are added up in tasks and then in the cluster; the driver gets a number a
bucket. Ranks come from range partitions, not from one sort.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, encoding
from sparkloom.sources import dialog

RUN_WORDS, BUCKETS, SEED = 2, 10_000, 7
#: Documents of fewer words aren't drawn; of the others, so many hundredths are.
LEAST_WORDS, DRAWN_PERCENT = 20, 25
#: Texts of more bytes are chunked, into chunks of about as many.
CHUNK_BYTES = 65_536
#: Bytes of texts that are handled at once.
SLICE_BYTES = 1_000_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

#: What a byte counts as: A-Z in lower case, other ASCII but letters and digits a gap (0),
#: bytes of other characters themselves.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
GAP, WORD = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"), re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _crc_table() -> np.ndarray:
    """crc32 of single bytes, by the polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def extended(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 states (before their last inversion) after ``size`` more bytes each, all words
    at once, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    s, at, n = state[order], start[order], size[order]
    first = int(np.searchsorted(-n, -LONG_WORD, "left"))  # the few long ones before it
    for i in range(first):
        s[i] = zlib.crc32(data[at[i] : at[i] + n[i]], int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for k in range(int(n[first]) if first < n.size else 0):
        to = int(np.searchsorted(-n, -k, "left"))
        s[first:to] = _step(s[first:to], data[at[first:to] + k])
    out = np.empty_like(s)
    out[order] = s
    return out


def runs(data: np.ndarray, bounds: np.ndarray, own: np.ndarray, n: int = RUN_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``n`` words that starts in the first ``own``
    bytes of its text, and the texts' numbers of such words. ``data`` has all texts' UTF-8
    bytes, text i in bounds[i] to bounds[i+1]."""
    data = LETTERS[data]
    edge = np.zeros(data.size + 1, bool)
    edge[bounds] = True
    word = data != 0
    before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    size = np.flatnonzero(word & (~after | edge[1:])) + 1 - start
    text = np.searchsorted(bounds, start, "right") - 1
    owned = start - bounds[text] < own[text]
    place = np.flatnonzero(owned)
    state = extended(np.full(place.size, 0xFFFFFFFF, np.uint32), data, start[place], size[place])
    found = [(text[place], (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))]
    for k in range(1, n):
        goes = place + k < start.size
        goes[goes] = text[place[goes] + k] == text[place[goes]]
        place, state = place[goes], _step(state[goes], np.uint32(32))
        state = extended(state, data, start[place + k], size[place + k])
        found.append((text[place], (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)))
    texts, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    return texts, hashed.astype(np.int64), np.bincount(found[0][0], minlength=bounds.size - 1)


def chunks(raw: bytes, n: int = RUN_WORDS, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(piece, bytes it owns): cuts at the first gap past ``size`` bytes; a piece has the
    n-1 words that follow what it owns. Longer words stay whole."""
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + size)
        stop = to = gap.start() if gap else len(raw)
        for _ in range(n - 1):
            carried = WORD.search(raw, stop)
            stop = carried.end() if carried else stop
        yield raw[at:stop], to - at
        at = to


# ---- tables


def pieces(docs: DataFrame, by: str, text: str, n: int = RUN_WORDS, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are, (doc_id, piece, own), and chunks of the long ones with their
    row's number, (row, doc_id, piece, own), written and dealt evenly."""
    rows = docs.select(F.col(by).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("piece"))
    short, long = F.octet_length("piece") <= size, F.octet_length("piece") > size

    def cut(batches):
        for batch in encoding.slices(batches, "piece", SLICE_BYTES):
            for row, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "piece")), strict=True):
                held, waiting = [], 0
                for piece, own in chunks(raw, n, size):
                    held.append((row, doc, piece, own))
                    waiting += len(piece)
                    if waiting > SLICE_BYTES:
                        yield _chunk_batch(held)
                        held, waiting = [], 0
                if held:
                    yield _chunk_batch(held)

    cuts = rows.where(long).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "piece").mapInArrow(cut, "row long, doc_id string, piece binary, own long")
    dealt = common.cut(cuts.repartition(common.shuffle_parts(docs.sparkSession)), "chunks")
    return rows.where(short).withColumn("own", F.octet_length("piece").cast("long")), dealt


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "doc_id", "piece", "own"])


def _of_batch(batch: pa.RecordBatch, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = batch.column("piece").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    return runs(data, offsets - offsets[0], batch.column("own").to_numpy(), n, buckets)


def bucket_counts(parts: list[DataFrame], n: int = RUN_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Runs in each bucket over all pieces; each task sums up its own first."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in encoding.slices(batches, "piece", SLICE_BYTES):
            total += np.bincount(_of_batch(batch, n, buckets)[1], minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = [p.select("piece", "own").mapInArrow(count, "bucket int, n long") for p in parts]
    both = counted[0]
    for c in counted[1:]:
        both = both.union(c)
    for r in both.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    size, s_all, t_all = corpus.size, float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1_000 * math.log(r)) for r in ratio], np.int64)


def _gained(part: DataFrame, keep: list[str], gain: np.ndarray, n: int) -> DataFrame:
    """``keep`` columns, words, n_features, gain of each piece."""
    shared = part.sparkSession.sparkContext.broadcast(gain)

    def score(batches):
        for batch in encoding.slices(batches, "piece", SLICE_BYTES):
            text, bucket, words = _of_batch(batch, n, shared.value.size)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, text, shared.value[bucket])
            cells = [words.astype(np.int64), np.bincount(text, minlength=batch.num_rows).astype(np.int64), total]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, cells)], [*keep, "words", "n_features", "gain"])

    kinds = {"row": "long", "doc_id": "string"}
    return part.mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", words long, n_features long, gain long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id's text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4_294_967_296.0
    return F.floor(-1_000.0 * F.ln(-F.ln(share)))


def resample(docs: DataFrame, target: DataFrame, by: str = "doc_id", text: str = "text", target_text: str = "text", n: int = RUN_WORDS, buckets: int = BUCKETS, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is 1, 2, ...
    over the drawn ones and null for others.

    Null texts, in both tables, have no words; texts without words have the weight 0. Null
    ids hash as the empty text and come first in ties; repeated rows are drawn each for
    themselves. An empty target gives every run the gain of an unseen one. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    short, long = pieces(docs, by, text, n, chunk_bytes)
    want = bucket_counts(list(pieces(target, target_text, target_text, n, chunk_bytes)), n, buckets)
    gain = gains(bucket_counts([short, long], n, buckets), want)
    whole = _gained(short.select("doc_id", "piece", "own"), ["doc_id"], gain, n)
    summed = _gained(long, ["row", "doc_id"], gain, n).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("words", "n_features", "gain")]).drop("row")
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    rows = whole.unionByName(summed).select(F.col("doc_id").cast("long").alias("doc_id"), "words", "n_features", mean.cast("long").alias("weight"), noise(F.coalesce("doc_id", F.lit("")), seed).alias("noise"))
    scored = common.cut(rows.select("doc_id", "words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"), F.monotonically_increasing_id().alias("place")), "scored")
    may = scored.where(F.col("words") >= least_words)
    drawn = percent * may.count() // 100
    ranked = dialog.numbered(may, F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "place", into="rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(F.col("words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn towards the benchmark's texts."""
    return resample(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 by its polynomial, once for each distinct run.
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
h AS (SELECT f, hex(f) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
c AS (SELECT f, xor(4294967295::BIGINT, list_reduce(list_transform(range(0, 4 * length(x)), lambda i: (((instr('0123456789ABCDEF', x[i // 8 * 2 + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[i // 8 * 2 + 2]) - 1) >> (i % 8)) & 1),
  lambda a, bit: xor(a >> 1, CASE WHEN (xor(a, bit) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), 4294967295::BIGINT)) % 10000 AS k FROM h),
s AS (SELECT k, count(*) AS s FROM df JOIN c USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bf JOIN c USING (f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k)),
m AS (SELECT row, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM df JOIN c USING (f) JOIN g USING (k) GROUP BY row),
z AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (row)),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY words >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM r"""
