"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments; each one is a table. Rows are entered in every table
under their own segment and look up the small Hamming ball around it. Of two neighbours
only the one with the smaller segment looks the other up, so a pair meets once per table. Rows that meet are
verified on their complete fingerprints.

``simhash_groups`` links 64-bit fingerprints within ``radius`` bits, exactly: with
radius = m*q + a over m segments, one of the first a+1 segments differs in at most q bits
or one of the others in at most q-1. ``near_copies`` links texts whose word shingles have
a Jaccard similarity of 0.8 or more: its tables are as many as that similarity asks for
at a stated recall. What it brings together, directly or through others, is one candidate
group, and within such groups every pair is compared, on sketches and then on the shingles.

Equal fingerprints are one row before any of this. A bucket emits a spanning forest of
its links, not its pairs. A bucket past ``bucket_max`` isn't gathered: its table rows are
dealt into blocks that the bucket's other rows stream past, with the same result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm import common, encoding
from sparkloom.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BUCKET_MAX = 20_000
#: Verified at once; a dense bucket past this size absorbs its links one seed at a time.
PAIRS_AT_ONCE = 200_000
DENSE = 2_048
#: Bytes of one text that are hashed at once, and of texts taken from a batch at once.
PIECE_BYTES, SLICE_BYTES = 200_000, 1_000_000
#: Near copies: words of a shingle, least Jaccard similarity, and the share of pairs at
#: exactly that similarity that the tables have to bring together.
COPY_WORDS, COPY_SIMILARITY, COPY_RECALL = 5, 0.8, 0.98
#: Words of a fingerprint that travel with its table rows, and their bits' radius: at the
#: least similarity almost all pairs differ in fewer, and hardly any other do.
COPY_CHECK, COPY_RADIUS = 2, 36
#: Bytes of shingles of a candidate group that a task holds while as many stream past.
GROUP_BYTES = 4_000_000
#: Places of a sketch, and standard deviations that its estimate may fall short by.
SKETCH, SKETCH_SLACK = 256, 4.0
#: A segment has this many bits less than the corpus's size, so that buckets stay small.
COPY_SLACK = 4

_GAP = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles in order, a piece of the text at a time. Texts of
    fewer words have one shingle of all; texts without words none."""
    raw, carry, at, some = (text or "").encode(), [], 0, False
    digest = xxhash.xxh64_intdigest
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE_BYTES)
        to = gap.start() if gap else len(raw)
        words = carry + raw[at:to].lower().split()  # bytes: A-Z only, and ASCII white space
        at = to
        if len(words) >= width:
            some = True
            row = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            start = np.cumsum(size + 1) - size - 1
            stop = (start + size)[width - 1 :].tolist()
            yield np.array([digest(row[a:b], SEED) for a, b in zip(start.tolist(), stop, strict=False)], np.uint64)
            words = words[len(words) - width + 1 :] if width > 1 else []
        carry = words
    if carry and not some:
        yield np.array([digest(b" ".join(carry), SEED)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of a text over its shingles, repeats included; 0 for texts without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        ones += _ones(hashes)
        n += hashes.size
    return _majority(ones, n)


def fingerprints(docs: DataFrame, by: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in encoding.slices(batches, "text", SLICE_BYTES):
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(by).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---- the index


@dataclass(frozen=True)
class Segment:
    """Bits ``lo`` to ``lo + bits`` of a fingerprint's word, and the ball to look up."""

    word: int
    lo: int
    bits: int
    ball: int


def segments(parts: int, radius: int) -> list[Segment]:
    """Segments of one 64-bit word that miss no pair within ``radius``."""
    q, a = divmod(radius, parts)
    bounds = [64 * k // parts for k in range(parts + 1)]
    found = [Segment(0, lo, hi - lo, q if k <= a else q - 1) for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    return [s for s in found if s.ball >= 0]  # no ball, no table


def _flips(key: Column, bits: int, ball: int) -> Column | None:
    """Keys of the ball around ``key`` that are larger: a pair meets from its smaller side."""
    if ball < 1:
        return None
    spots = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
    layers = [F.transform(spots, lambda s: F.struct(key.bitwiseXOR(s).alias("key"), s.alias("last")))]
    for _ in range(ball - 1):
        more = lambda x: F.transform(F.filter(spots, lambda s: s > x["last"]), lambda s: F.struct(x["key"].bitwiseXOR(s).alias("key"), s.alias("last")))
        layers.append(F.flatten(F.transform(layers[-1], more)))
    return F.filter(F.transform(F.concat(*layers), lambda x: x["key"]), lambda k: k > key)


def _entry(key: Column, table: int, looks: bool) -> Column:
    return F.struct(key.bitwiseOR(F.lit(table << 40).cast("long")).alias("code"), F.lit(looks).alias("looks"))


def _look_ups(keys: Column, table: int) -> Column:
    return F.transform(keys, lambda key: _entry(key, table, True))


def probes(rows: DataFrame, segs: list[Segment], carried: list[str]) -> DataFrame:
    """(code, looks, carried): table rows under their own segments, and look-ups. Words
    are columns f0, f1, ...; each carried column travels along."""
    codes = []
    for k, s in enumerate(segs):
        key = F.shiftrightunsigned(F.col(f"f{s.word}"), s.lo).bitwiseAND(F.lit((1 << s.bits) - 1).cast("long"))
        codes.append(F.array(_entry(key, k, False)))
        around = _flips(key, s.bits, s.ball)
        if around is not None:
            codes.append(_look_ups(around, k))
    return rows.select(*carried, F.explode(F.concat(*codes)).alias("p")).select("p.code", "p.looks", *carried)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words, broadcast."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _forest(node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links: each newly reached row leaves the pool, so a tight
    group costs about one pass per few members."""
    node, first = np.unique(node, return_index=True)
    fp, a, b = fp[first], [], []
    while node.size > 1:
        root, reached = int(node[0]), [fp[0]]
        node, fp = node[1:], fp[1:]
        while reached and node.size:
            near = _apart(fp, reached.pop()) <= radius
            if near.any():
                a += [root] * int(near.sum())
                b += node[near].tolist()
                reached += list(fp[near])
                node, fp = node[~near], fp[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _verify(code: np.ndarray, looks: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole buckets, rows sorted by code with table rows first."""
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    end = np.append(start[1:], code.size)
    size = end - start
    for g in np.flatnonzero((size > DENSE) & ~looks[start]):
        yield _forest(node[start[g] : end[g]], fp[start[g] : end[g]], radius)
    group = np.repeat(np.arange(start.size, dtype=np.int32), size)
    table = np.flatnonzero(~looks & (size[group] > 1) & (size[group] <= DENSE))
    rest = end[group[table]] - table - 1
    table, rest = table[rest > 0], rest[rest > 0]
    chunk = np.cumsum(rest) // PAIRS_AT_ONCE
    for c in np.unique(chunk):
        left, count = table[chunk == c], rest[chunk == c]
        i = np.repeat(left, count)
        j = i + 1 + np.arange(i.size) - np.repeat(np.cumsum(count) - count, count)
        close = _apart(fp[i], fp[j]) <= radius
        i, j = i[close], j[close]
        if not i.size:
            continue
        own = group[i]
        dense = np.flatnonzero(np.bincount(own, minlength=start.size) > 2 * size)
        for g in dense:
            yield _forest(node[start[g] : end[g]], fp[start[g] : end[g]], radius)
        sparse = ~np.isin(own, dense)
        if sparse.any():
            yield node[i[sparse]], node[j[sparse]]


def _unpacked(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy().view(np.uint64) for n in names], axis=1)


def bucket_links(rows: DataFrame, words: list[str], radius: int, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """(a, b, code, looks, words) from sorted buckets: links (a, b), or rows of buckets over
    ``bucket_max`` rows as they came, with a null b."""
    schema = "a long, b long, code long, looks boolean, " + ", ".join(f"{w} long" for w in words)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * len(words)]

    def out(columns: list[np.ndarray | None], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "code", "looks", *words])

    def link(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return out([a, b, None, None, *[None] * len(words)], a.size)

    def passed(held: list[np.ndarray]) -> pa.RecordBatch:
        code, looks, node, fp = held
        return out([node, None, code, looks, *(np.ascontiguousarray(fp[:, k]).view(np.int64) for k in range(len(words)))], node.size)

    def run(batches):
        held, skipped = None, None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), _unpacked(batch, words)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if skipped is not None:  # the rest of a bucket that is too large
                over = held[0] == skipped
                if over.any():
                    yield passed([x[over] for x in held])
                    held = [x[~over] for x in held]
            if not held[0].size:
                continue
            open_from = int(np.searchsorted(held[0], held[0][-1]))
            whole, held = [x[:open_from] for x in held], [x[open_from:] for x in held]
            if whole[0].size:
                yield from (link(a, b) for a, b in _verify(*whole, radius) if a.size)
            if held[0].size > bucket_max:
                skipped = held[0][-1]
                yield passed(held)
                held = [x[:0] for x in held]
        if held is not None and held[0].size:
            yield from (link(a, b) for a, b in _verify(*held, radius) if a.size)

    sorted_rows = rows.repartition(common.shuffle_parts(rows.sparkSession), "code").sortWithinPartitions("code", "looks")
    return sorted_rows.select("code", "looks", "node", *words).mapInArrow(run, schema)


def block_links(over: DataFrame, words: list[str], radius: int, block: int = BUCKET_MAX) -> DataFrame:
    """(a, b) links of buckets too large for one task, any radius: their table rows are
    dealt into blocks of about ``block``, and every row of the bucket streams past each
    block. A row hands on one link per group of the block that it touches."""
    sizes = over.where("not looks").groupBy("code").agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = over.join(sizes, "code")
    own = rows.where("not looks").select("code", F.pmod(F.xxhash64("a"), "blocks").alias("block"), F.lit(False).alias("streams"), F.col("a").alias("node"), *words)
    past = rows.select("code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("streams"), F.col("a").alias("node"), *words)

    def run(batches):
        key, table, fp, label = None, [], None, None
        for batch in batches:
            codes = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            streams, node, rows_fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), _unpacked(batch, words)
            cut = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1) | (streams[1:] != streams[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(codes)], strict=True):
                if lo == hi:
                    continue
                if key != tuple(codes[lo]):
                    key, table, label = tuple(codes[lo]), [], None
                if not streams[lo]:
                    table.append((node[lo:hi], rows_fp[lo:hi]))
                    continue
                if not table:
                    continue
                if label is None:
                    own_node, fp = (np.concatenate(x) for x in zip(*table, strict=True))
                    a, b = _forest(own_node, fp, radius)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    # the forest's edges run from a group's first node to its others
                    label = own_node.copy()
                    order = np.argsort(b)
                    at = np.minimum(np.searchsorted(b[order], own_node), max(b.size - 1, 0))
                    if b.size:
                        hit = b[order][at] == own_node
                        label[hit] = a[order][at][hit]
                for at in range(lo, hi, 64):
                    near = _apart(rows_fp[at : min(at + 64, hi), None, :], fp[None]) <= radius
                    i, j = np.nonzero(near)
                    met = np.unique(np.stack([node[at + i], label[j]], axis=1), axis=0) if i.size else np.zeros((0, 2), np.int64)
                    met = met[met[:, 0] != met[:, 1]]
                    if len(met):
                        yield pa.RecordBatch.from_arrays([pa.array(met[:, 0].copy()), pa.array(met[:, 1].copy())], ["a", "b"])

    spread = own.unionByName(past).repartition(common.shuffle_parts(over.sparkSession), "code", "block").sortWithinPartitions("code", "block", "streams")
    return spread.mapInArrow(run, "a long, b long")


def links_of(rows: DataFrame, segs: list[Segment], words: list[str], radius: int, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """(a, b): links among ``rows`` (node and fingerprint words), enough to connect all
    that the index brings together within ``radius``."""
    spread = rows.repartition(common.shuffle_parts(rows.sparkSession), "node")
    found = common.cut(bucket_links(probes(spread, segs, ["node", *words]), words, radius, bucket_max), "links")
    edges, over = found.where("b is not null").select("a", "b"), found.where("b is null")
    if over.limit(1).count():
        edges = edges.unionByName(block_links(over.select("a", "code", "looks", *words), words, radius, bucket_max))
    return edges


# ---- 64-bit fingerprints within a radius


def near_groups(prints: DataFrame, radius: int = RADIUS, parts: int | None = None, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint: the smallest doc_id reachable.

    ``parts`` is the number of segments: 3 (21 bits or more each) below 2^27 distinct
    fingerprints, else 2 (32 bits), which keeps random buckets small; both are exact.
    """
    fps = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    if parts is None:
        parts = 3 if fps.count() < 2**27 else 2
    roots = components(links_of(fps.select(F.col("fp").alias("node"), F.col("fp").alias("f0")), segments(parts, radius), ["f0"], radius, bucket_max))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = common.cut(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, by: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated
    rows are kept. A component whose ids are all null has a null component_id. An empty
    table gives no rows; other columns are ignored.
    """
    prints = common.cut(fingerprints(docs, by, text), "prints")
    groups = near_groups(prints, radius, bucket_max=bucket_max)
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by Jaccard similarity of word shingles


def differing_share(similarity: float) -> float:
    """Expected share of differing SimHash bits at a Jaccard similarity of equal-sized sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def copy_segments(rows: int, similarity: float = COPY_SIMILARITY, recall: float = COPY_RECALL) -> list[Segment]:
    """Tables for ``rows`` texts. Their bits follow the corpus's size, so that a bucket's
    random rows don't; the ball is 1; their number follows from the recall asked for."""
    bits = min(max(math.ceil(math.log2(max(rows, 2))) - COPY_SLACK, 8), 32)
    p = differing_share(similarity)
    meets = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    each = 64 // bits
    return [Segment(k // each, k % each * bits, bits, 1) for k in range(tables)]


def shingle_set(text: str | None, width: int = COPY_WORDS) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    found = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """Name of a shingle set, a signed long."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) - 2**63


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of distinct shingles in any number of 64-bit words; a further word's bits
    are a further mix of the hashes."""
    out = np.zeros(words, np.uint64)
    for k in range(words if hashes.size else 0):
        ones, n = np.zeros(64, np.int64), hashes.size
        for at in range(0, n, 20_000):
            h = hashes[at : at + 20_000]
            if k:
                h = (h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            ones += _ones(h)
        out[k] = _majority(ones, n)
    return out


def copy_prints(rows: DataFrame, words: int, width: int = COPY_WORDS) -> DataFrame:
    """(doc_id, node, f0, ...) of rows of doc_id and text."""
    names = [f"f{k}" for k in range(words)]

    def run(batches):
        for batch in encoding.slices(batches, "text", SLICE_BYTES):
            node, found = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, words), np.uint64)
            for i, t in enumerate(batch.column("text")):
                hashes = shingle_set(t.as_py(), width)
                node[i], found[i] = set_key(hashes), wide_fingerprint(hashes, words)
            columns = [np.ascontiguousarray(found[:, k]).view(np.int64) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), *map(pa.array, columns)], ["doc_id", "node", *names])

    return rows.mapInArrow(run, "doc_id long, node long, " + ", ".join(f"{n} long" for n in names))


def shingle_sets(rows: DataFrame, width: int = COPY_WORDS) -> DataFrame:
    """(root, node, shingles) of rows of root, node and text whose text has that node's
    shingles."""

    def run(batches):
        for batch in encoding.slices(batches, "text", SLICE_BYTES):
            keep, sets = [], []
            for i, (node, t) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text"), strict=True)):
                hashes = shingle_set(t.as_py(), width)
                if set_key(hashes) == node:
                    keep.append(i)
                    sets.append(hashes.view(np.int64))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("root").take(at), batch.column("node").take(at), pa.array(sets, pa.list_(pa.int64()))], ["root", "node", "shingles"])

    return rows.mapInArrow(run, "root long, node long, shingles array<long>")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte for each place that the hashes fall to: of the least hash there. 0 marks a
    place that none falls to."""
    out = np.zeros(SKETCH, np.uint8)
    if hashes.size:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(mixed % np.uint64(SKETCH) * np.uint64(1 << 55) + (mixed >> np.uint64(9)))
        place = (mixed[order] % np.uint64(SKETCH)).astype(np.int64)
        own, first = np.unique(place, return_index=True)
        out[own] = (mixed[order[first]] >> np.uint64(12)) % np.uint64(255) + np.uint64(1)
    return out


class Group:
    """Rows of a candidate group that a task holds, in sets joined by verified links."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.node: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.root: list[int] = []
        self.known: dict[int, int] = {}
        self.sketches, self.sizes = np.zeros((64, SKETCH), np.uint8), np.zeros(64, np.int64)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def likely(self, hashes: np.ndarray) -> np.ndarray:
        """Rows that may be that similar, the likeliest first."""
        n, size = len(self.node), hashes.size
        fits = np.flatnonzero(np.minimum(self.sizes[:n], size) >= self.similarity * np.maximum(self.sizes[:n], size))
        if not fits.size:
            return fits
        own, other = sketch(hashes), self.sketches[fits]
        there = ((own != 0) | (other != 0)).sum(axis=1)
        share = ((own == other) & (own != 0)).sum(axis=1) / np.maximum(there, 1)
        slack = SKETCH_SLACK * np.sqrt(self.similarity * (1 - self.similarity) / np.maximum(there, 1))
        near = np.flatnonzero((share >= self.similarity - slack) | (there == 0))
        return fits[near[np.argsort(-share[near], kind="stable")]]

    def similar(self, i: int, hashes: np.ndarray) -> bool:
        shared = np.intersect1d(self.hashes[i], hashes, assume_unique=True).size
        return shared >= self.similarity * (self.sizes[i] + hashes.size - shared)

    def meet(self, node: int, hashes: np.ndarray) -> list[int]:
        """Nodes of the rows that a row is linked with, one for each set of them."""
        links: list[int] = []
        joined: set[int] = set()
        for i in self.likely(hashes).tolist():
            root = self.find(i)
            if root not in joined and self.similar(i, hashes):
                joined.add(root)
                links.append(self.node[i])
        if len(joined) > 1:  # the row joins them
            least = min(joined)
            for root in joined:
                self.root[root] = least
        return links

    def add(self, node: int, hashes: np.ndarray, compare: bool = True) -> list[int]:
        links, n = self.meet(node, hashes) if compare else [], len(self.node)
        if n == len(self.sizes):
            self.sketches, self.sizes = np.concatenate([self.sketches, np.zeros_like(self.sketches)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.sketches[n], self.sizes[n] = sketch(hashes), hashes.size
        self.node.append(node)
        self.hashes.append(hashes)
        self.known[node] = n
        self.root.append(self.find(self.known[links[0]]) if links else n)
        return links


def verified(groups: DataFrame, similarity: float, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b) links of rows (root, node, shingles) that join, within each candidate group
    ``root``, all whose shingles have that Jaccard similarity, directly or through others.

    A group's rows are dealt into blocks of about ``group_bytes``; a task holds one block while
    another one, or none, streams past, so each pair of blocks is a task of its own. Pairs of
    one set are not compared again, sketches settle most others (one at exactly the least
    similarity passes with a probability of 0.9999), the rest are compared on the shingles.
    Only links that join two sets are handed on, so a task makes no more of them than it has
    rows. Repeated nodes are one.
    """
    weight = groups.groupBy("root").agg(F.ceil(F.sum(F.size("shingles") * 8.0 + 8) / group_bytes).alias("blocks"))
    rows = groups.join(weight, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = rows.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "own", "node", "shingles")
    dealt = dealt.select("root", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("past"), (F.col("own") > F.col("other")).alias("streams"), "node", "shingles")

    def run(batches):
        key, group, links = None, None, []
        for batch in batches:
            shingles = batch.column("shingles")
            for i, (root, block, past, streams, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "block", "past", "streams", "node")), strict=True)):
                if (root, block, past) != key:
                    key, group = (root, block, past), Group(similarity)
                if node in group.known:
                    continue
                hashes = shingles[i].values.to_numpy(zero_copy_only=False).view(np.uint64).copy()
                links += [(node, other) for other in (group.meet(node, hashes) if streams else group.add(node, hashes, block == past))]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])
                links = []

    spread = dealt.repartition(common.shuffle_parts(groups.sparkSession), "root", "block", "past").sortWithinPartitions("root", "block", "past", "streams", "node")
    return spread.select("root", "block", "past", "streams", "node", "shingles").mapInArrow(run, "a long, b long")


def _fewer(links: DataFrame) -> DataFrame:
    """As connected as ``links``: a node's smaller neighbours are linked with the smallest of
    them instead. A node has as many of them as it has places in the index, at most that many
    times a small bucket's rows."""
    near = links.where("a <> b").groupBy(F.greatest("a", "b").alias("a")).agg(F.collect_set(F.least("a", "b")).alias("near"))
    moved = near.select(F.array_min("near").alias("b"), F.explode(F.array_append("near", F.col("a"))).alias("a"))
    return moved.where("a <> b").select("a", "b").distinct()


def near_copies(docs: DataFrame, by: str = "doc_id", text: str = "text", width: int = COPY_WORDS, similarity: float = COPY_SIMILARITY, bucket_max: int = BUCKET_MAX, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, node, root) of every row with an id: rows of one root are near copies,
    directly or through others.

    Two texts are linked if the Jaccard similarity of their distinct word shingles is
    ``similarity`` or more (texts of fewer than ``width`` words are one shingle; texts
    without words are copies of each other) and the index brought them together, directly or
    through others. Each link is verified on the shingles; pairs of different texts at
    exactly the least similarity meet with a probability of ``COPY_RECALL``, closer ones more
    surely, equal ones always. Null texts are empty. An empty table gives no rows.
    """
    rows = docs.where(F.col(by).isNotNull()).select(F.col(by).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    segs = copy_segments(rows.count(), similarity)
    words = max(COPY_CHECK, segs[-1].word + 1)
    prints = common.cut(copy_prints(rows, words, width), "prints")
    names = [f"f{k}" for k in range(words)]
    nodes = common.cut(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.min(n).alias(n) for n in names]), "nodes")
    met = common.cut(components(_fewer(links_of(nodes, segs, names[:COPY_CHECK], COPY_RADIUS, bucket_max))), "met")
    # a node's text is the one of its least id; a text that has other shingles drops out
    places = nodes.select("node", "doc_id").join(met, "node")
    sets = shingle_sets(rows.join(places, "doc_id").select("root", "node", "text"), width)
    roots = components(verified(common.cut(sets, "shingles"), similarity, group_bytes))
    return prints.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def one_per_group(docs: DataFrame, by: str = "doc_id", text: str = "text", width: int = COPY_WORDS, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """``docs`` with the smallest id of each group of near copies only (:func:`near_copies`).

    Rows with null ids stay, they take no part. Of several rows with one id that stays, the
    one with the smallest hash of all its columns stays (equal rows: one of them). Null and
    empty texts are copies of each other. An empty table stays empty. Columns keep their
    names, whatever these are.
    """
    groups = near_copies(docs, by, text, width, similarity)
    kept = groups.groupBy("root").agg(F.min("doc_id").alias(by)).select(by).distinct()
    stay = docs.where(F.col(by).isNotNull()).join(kept, by, "left_semi")
    rows, ids = docs.agg(F.count(by), F.countDistinct(by)).first()
    if rows != ids:
        place = common.free_name(docs.columns, "place")
        first = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64(*docs.columns)))
        stay = stay.withColumn(place, first).where(F.col(place) == 1)
    return stay.select(*docs.columns).unionByName(docs.where(F.col(by).isNull()))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash_groups(common.documents(spark, sf_dir))
