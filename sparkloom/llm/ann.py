"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of L tables hashes a vector by M projections, floor((a.x + b) / w). A query visits,
per table, the T buckets reached by moving each coordinate by -1, 0 or 1 in estimated
success order: ascending sum of squared distances to the crossed bucket borders. T is
fitted on a bounded sample to a recall target; every vector is indexed.

Buckets are dealt into cells of about ``CELL_ROWS`` table entries, whatever the table's
size; larger buckets are split over several cells. A query travels to each cell that
holds buckets it visits, with the cost of its last probe per table. A cell holds its
entries and lets the queries stream past in blocks; each one hands on its k best of the
cell. What a task holds doesn't grow with the table.

Queries that find fewer than k this way, outliers or those of small tables, go through an
exact scan: blocks of them are sent to all vectors.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm import common

TABLES, PROJECTIONS, WIDTH = 3, 8, 2.0
#: Rows (about) and queries of the sample that the index is fitted on.
SAMPLE_ROWS, SAMPLE_QUERIES = 4_000, 200
RECALL_TARGET = 0.98
#: Table entries per cell; a query hands on k rows per cell it visits. The driver gets the
#: codes of buckets over this size: 16 bytes for each CELL_ROWS entries at most.
CELL_ROWS = 20_000
#: Queries that are compared with a cell at once.
QUERY_BLOCK = 256
#: Bytes of the query vectors that one exact scan sends to the executors.
SCAN_BYTES = 4_000_000
SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Index:
    """Hash functions and the number of probes per table."""

    project: np.ndarray  # (tables, dim, projections)
    shift: np.ndarray
    width: float
    probes: int

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket coordinates (tables, rows, projections) and places inside (0 to 1)."""
        f = (np.einsum("nd,tdm->tnm", x, self.project) + self.shift[:, None, :]) / self.width
        h = np.floor(f)
        return h.astype(np.int64), f - h

    def codes(self, h: np.ndarray) -> np.ndarray:
        """One 63-bit code per table and bucket."""
        code = np.zeros(h.shape[:-1], np.uint64) + np.arange(1, h.shape[0] + 1, dtype=np.uint64).reshape(-1, *[1] * (h.ndim - 2))
        for m in range(h.shape[-1]):
            code = (code ^ h[..., m].astype(np.uint64)) * MIX
            code ^= code >> np.uint64(29)
        return (code >> np.uint64(1)).astype(np.int64)

    def visits(self, x: np.ndarray, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes (tables, rows, probes) in estimated success order, and their costs."""
        h, f = self.cells(x)
        moves = np.array(list(itertools.product((-1, 0, 1), repeat=h.shape[-1])), np.int64)
        one_hot = np.zeros((3 * h.shape[-1], len(moves)))
        for m in range(h.shape[-1]):
            one_hot[3 * m + moves[:, m] + 1, np.arange(len(moves))] = 1
        total = move_costs(f).reshape(*f.shape[:-1], -1) @ one_hot
        order = np.argsort(total, axis=-1, kind="stable")[..., : probes or self.probes]
        return self.codes(h[:, :, None, :] + moves[order]), np.take_along_axis(total, order, axis=-1)

    def meets(self, x: np.ndarray, most: np.ndarray, table: int, bucket: np.ndarray) -> np.ndarray:
        """Which rows of ``x`` (queries, whose last probe costs ``most`` per table) visit
        which of a table's buckets, given by coordinates: (rows, buckets)."""
        h, f = self.cells(x)
        move = bucket[None] - h[table][:, None, :]
        near = (np.abs(move) <= 1).all(axis=-1)
        q, c = np.nonzero(near)
        cost = np.take_along_axis(move_costs(f[table])[q], (move[q, c] + 1)[..., None], axis=-1).sum(axis=(1, 2))
        near[q, c] = cost <= most[q, table] * (1 + 1e-9) + 1e-12  # sums in another order
        return near


def move_costs(f: np.ndarray) -> np.ndarray:
    """Squared distance to the border crossed by moves of -1, 0 and 1 from a place."""
    return np.stack([f**2, np.zeros_like(f), (1 - f) ** 2], axis=-1)


def vectors(rows: DataFrame, by: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: id and vector there, no null or
    non-finite component, not all zero. Kept in the type they have."""
    v = F.col(column)
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = F.col(by).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    return rows.where(ok).where(F.forall(v, good) & F.exists(v, lambda c: c != 0)).select(F.col(by).cast("long").alias("vec_id"), v.alias("vec"))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 rows; vectors of another length than ``dim`` are left out."""
    column = batch.column("vec")
    size = np.diff(column.offsets.to_numpy())
    keep = size == dim
    if not keep.all():
        column = column.filter(pa.array(keep))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column("vec_id").to_numpy()[keep], flat.reshape(-1, dim)


def fit(vecs: DataFrame, k: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, target: float = RECALL_TARGET) -> tuple[Index | None, int, int]:
    """Index, dimension and number of vectors. The dimension is the most common one.

    The sample's rows are about ``SAMPLE_ROWS``; the rank that stands for the k-th
    neighbour shrinks with the sample, and neighbours in a sample are further off than in
    the table, so the number of probes errs to the high side.
    """
    dims = {r["d"]: r["n"] for r in vecs.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    if not dims:
        return None, 0, 0
    ((dim, n),) = dims.items()
    share = min(1.0, SAMPLE_ROWS / n)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1_000_000)) / 1e6
    some = vecs.where((F.size("vec") == dim) & (draw < share)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE_ROWS).toArrow()
    x = np.array(some["vec"].to_pylist(), np.float64).reshape(-1, dim)
    rng = np.random.default_rng(SEED)
    spread = float(np.sqrt(x.var(axis=0).sum())) or float(np.linalg.norm(x[0])) or 1.0
    index = Index(rng.standard_normal((tables, dim, projections)), rng.uniform(0, width * spread, (tables, projections)), width * spread, 3**projections)
    q = x[:SAMPLE_QUERIES]
    gap = (q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T
    gap[np.arange(len(q)), np.arange(len(q))] = np.inf
    rank = min(max(1, round(k * len(x) / n)), len(x) - 1)
    if rank < 1:
        return index, dim, n
    near = np.argpartition(gap, rank - 1, axis=1)[:, :rank]
    own = index.codes(index.cells(x)[0])
    first = np.full(near.shape, index.probes)
    for t, table in enumerate(index.visits(q)[0]):
        for i, codes in enumerate(table):
            order = np.argsort(codes)
            at = np.minimum(np.searchsorted(codes[order], own[t][near[i]]), codes.size - 1)
            hit = codes[order][at] == own[t][near[i]]
            first[i] = np.where(hit, np.minimum(first[i], order[at]), first[i])
    index.probes = int(min(np.quantile(first, target, method="higher") + 1, 3**projections))
    return index, dim, n


class Best:
    """The k nearest of each query so far: (distance, id), ties to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm = (x**2).sum(1)
        self.bound = np.full(ids.size, np.inf)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def offer(self, who: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        for a in range(0, ids.size, 2_048):
            i, z = ids[a : a + 2_048], y[a : a + 2_048]
            for b in range(0, who.size, 512):
                w = who[b : b + 512]
                gap = self.norm[w][:, None] + (z**2).sum(1) - 2 * self.x[w] @ z.T
                r, c = np.nonzero((gap <= self.bound[w][:, None]) & (self.ids[w][:, None] != i))
                if r.size:
                    d = np.sqrt(((self.x[w[r]] - z[c]) ** 2).sum(1))
                    found = np.empty(r.size, [("q", "i8"), ("d", "f8"), ("v", "i8")])
                    found["q"], found["d"], found["v"] = w[r], d, i[c]
                    self.parts.append(found)
                    self.size += r.size
                if self.size > 500_000 or not np.isfinite(self.bound[w]).all():
                    self.settle()

    def settle(self) -> np.ndarray:
        if not self.parts:
            return np.empty(0, [("q", "i8"), ("d", "f8"), ("v", "i8")])
        x = np.unique(np.concatenate(self.parts))  # by query, distance, id
        order = np.lexsort((x["v"], x["q"]))  # stable: an id's nearest row comes first
        again = (x["q"][order[1:]] == x["q"][order[:-1]]) & (x["v"][order[1:]] == x["v"][order[:-1]])
        x = np.delete(x, order[1:][again])
        rank = np.arange(x.size) - np.searchsorted(x["q"], x["q"])
        last = x[rank == self.k - 1]
        self.bound[last["q"]] = last["d"] ** 2 * (1 + 1e-9) + 1e-12  # the product form is rounded
        x = x[rank < self.k]
        self.parts, self.size = [x], 0
        return x


def exact(vecs: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the k nearest of each row of ``asked`` (vec_id, vec) in
    each partition of ``vecs``, by blocks of at most ``SCAN_BYTES``."""
    block = max(1, SCAN_BYTES // (8 * dim))
    schema = "query_id long, vec_id long, score double"
    asked = common.cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-asked.count() // block)))), "asked")
    found = []
    for r in asked.select("block").distinct().collect():
        rows = asked.where(F.col("block") == r["block"]).select("vec_id", "vec").toArrow().combine_chunks().to_batches()
        queries = vecs.sparkSession.sparkContext.broadcast(_matrix(rows[0], dim))

        def scan(batches, queries=queries):
            best = Best(*queries.value, k)
            who = np.arange(best.ids.size)
            for batch in batches:
                best.offer(who, *_matrix(batch, dim))
            x = best.settle()
            if x.size:
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[x["q"]]), pa.array(x["v"].copy()), pa.array(x["d"].copy())], ["query_id", "vec_id", "score"])

        found.append(common.cut(vecs.mapInArrow(scan, schema), "exact"))
    return reduce(DataFrame.unionByName, found)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, by: str = "vec_id", column: str = "embedding", index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found.

    Queries are the vectors whose id is divisible by ``every``; candidates are all others
    by id. Score is the Euclidean distance in double precision. Rows without id, with null
    or empty vectors, null or non-finite components or only zeros take no part, nor do
    vectors of another than the most common length. Of repeated rows with one id each is
    a candidate and the nearest counts. An empty table gives no rows.
    """
    spark = rows.sparkSession
    vecs = vectors(rows, by, column)
    schema = "query_id long, rank int, vec_id long, score double"
    fitted, dim, n = fit(vecs, k)
    if fitted is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(index or fitted)
    tables = shared.value.project.shape[0]
    cells = max(1, -(-n * tables // CELL_ROWS))

    def count(batches):
        for batch in batches:
            _, x = _matrix(batch, dim)
            code, size = np.unique(shared.value.codes(shared.value.cells(x)[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(size, pa.int64())], ["code", "n"])

    sizes = vecs.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    hot = sizes.where(F.col("n") > CELL_ROWS).collect()  # at most one code for each CELL_ROWS entries
    wide = {r["code"]: -(-2 * r["n"] // CELL_ROWS) for r in hot}
    starts = dict(zip(wide, itertools.accumulate([cells, *wide.values()]), strict=False))

    def home(code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * MIX) >> np.uint64(33)).astype(np.int64) % cells

    def deal(batches):
        m = shared.value
        hot_codes = np.array(sorted(wide), np.int64)
        ways = np.array([wide[c] for c in hot_codes.tolist()], np.int64)
        first = np.array([starts[c] for c in hot_codes.tolist()], np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                ids, x = _matrix(whole.slice(at, 2_000), dim)
                if not ids.size:
                    continue
                out: dict[str, list] = {c: [] for c in ("cell", "asks", "table", "code", "id", "vec")}
                raw = [r.tobytes() for r in x]
                for t, code in enumerate(m.codes(m.cells(x)[0])):
                    cell = home(code)
                    is_hot = np.isin(code, hot_codes)
                    if is_hot.any():
                        p = np.searchsorted(hot_codes, code[is_hot])
                        cell[is_hot] = first[p] + ((ids[is_hot].astype(np.uint64) * MIX) >> np.uint64(40)).astype(np.int64) % ways[p]
                    out["cell"].append(cell)
                    out["asks"].append(np.zeros(ids.size, bool))
                    out["table"].append(np.full(ids.size, t, np.int32))
                    out["code"].append(code)
                    out["id"].append(ids)
                    out["vec"] += raw
                for i in np.flatnonzero(ids % every == 0).tolist():
                    codes, costs = m.visits(x[i : i + 1])
                    visits = np.unique(codes)
                    cell = home(visits)
                    split = np.flatnonzero(np.isin(visits, hot_codes))
                    p = np.searchsorted(hot_codes, visits[split])
                    cold = np.setdiff1d(np.arange(visits.size), split)
                    own = np.unique(np.concatenate([cell[cold], *[np.arange(a, a + b) for a, b in zip(first[p], ways[p], strict=True)]]))
                    asked = raw[i] + costs[:, 0, -1].tobytes()  # the vector, then its last probe's cost per table
                    out["cell"].append(own)
                    out["asks"].append(np.ones(own.size, bool))
                    out["table"].append(np.zeros(own.size, np.int32))
                    out["code"].append(np.zeros(own.size, np.int64))
                    out["id"].append(np.full(own.size, ids[i]))
                    out["vec"] += [asked] * own.size
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(out[c])) for c in ("cell", "asks", "table", "code", "id")), pa.array(out["vec"], pa.binary())], list(out))

    def search(batches):
        m, cell, parts, held = shared.value, None, [], None

        def compared(ids: np.ndarray, block: np.ndarray):
            base_id, base, buckets = held
            best = Best(ids, np.ascontiguousarray(block[:, :dim]), k)
            for t, (coordinates, begin, end) in buckets.items():
                near = m.meets(best.x, block[:, dim:], t, coordinates)
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    best.offer(np.flatnonzero(near[:, j]), base_id[begin[j] : end[j]], base[begin[j] : end[j]])
            found = best.settle()
            if found.size:
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[found["q"]]), pa.array(found["v"].copy()), pa.array(found["d"].copy())], ["query_id", "vec_id", "score"])

        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            cell_no, asks = cols["cell"].to_numpy(), cols["asks"].to_numpy(zero_copy_only=False)
            table, code, ids = cols["table"].to_numpy(), cols["code"].to_numpy(), cols["id"].to_numpy()
            cut = np.flatnonzero((cell_no[1:] != cell_no[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), cell_no.size], strict=True):
                if a == b:
                    continue
                if cell_no[a] != cell:
                    cell, parts, held = cell_no[a], [], None
                x = np.frombuffer(b"".join(cols["vec"].slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                if not asks[a]:
                    parts.append((table[a:b], code[a:b], ids[a:b], x))
                    continue
                if held is None and parts:
                    all_table, all_code, base_id, base = (np.concatenate(c) for c in zip(*parts, strict=True))
                    parts, buckets = [], {}
                    for t in np.unique(all_table).tolist():  # rows are sorted by table and code
                        lo, hi = np.searchsorted(all_table, [t, t + 1])
                        begin = lo + np.flatnonzero(np.concatenate([[True], all_code[lo + 1 : hi] != all_code[lo : hi - 1]]))
                        buckets[t] = (m.cells(base[begin])[0][t], begin, np.append(begin[1:], hi))
                    held = (base_id, base, buckets)
                if held is not None:
                    for at in range(a, b, QUERY_BLOCK):
                        to = min(at + QUERY_BLOCK, b)
                        yield from compared(ids[at:to], x[at - a : to - a])

    dealt = vecs.mapInArrow(deal, "cell long, asks boolean, table int, code long, id long, vec binary")
    spread = dealt.repartition(common.shuffle_parts(spark), "cell").sortWithinPartitions("cell", "asks", "table", "code")
    found = spread.mapInArrow(search, "query_id long, vec_id long, score double")
    pairs = common.cut(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "pairs")
    enough = pairs.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    asked = vecs.where((F.col("vec_id") % every == 0) & (F.size("vec") == dim))
    short = common.cut(asked.join(enough, "vec_id", "left_anti"), "short")
    if short.limit(1).count():
        both = pairs.unionByName(exact(vecs, short, dim, k))
        pairs = both.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth embedding."""
    return nearest(common.table(spark, sf_dir, "embeddings"))
