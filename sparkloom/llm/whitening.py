"""Embedding whitening by hierarchical SVD merging.

Vectors lie on a lattice of whole numbers, so their sums are exact. Each partition reduces
its vectors to a summary: their number, their sums, and the singular values and right
vectors of the centred rows, all of them. Two summaries are merged by stacking their scaled
right vectors and one row that corrects for the difference of their means, and taking the
SVD anew; nothing is cut off. Summaries are merged ``FAN_IN`` at a time, level by level, so
no task sees more than that many, and the driver gets the last one: numbers in the square
of the vectors' length, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common

#: Steps of a unit of an entry, and the whole number that is added.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Summaries that one task merges.
FAN_IN = 16
#: Rows that are reduced or whitened at once.
ROWS_AT_ONCE = 2_048
#: Entries of this size and more aren't whole numbers that a double tells apart.
EXACT = 2.0**53
#: A component whose singular value is under this share of the largest has no variance.
LEAST_SHARE = 1e-10
SUMMARY = "part int, n long, total array<string>, s array<double>, vt array<double>"


@dataclass
class Summary:
    """``total`` holds exact whole numbers, or doubles where rows are doubles."""

    n: int
    total: list
    s: np.ndarray
    vt: np.ndarray


def of_rows(rows: np.ndarray) -> Summary:
    """Summary of a block of rows, whole numbers or doubles."""
    n = len(rows)
    if rows.dtype.kind == "i":
        most = int(np.abs(rows).max(initial=0))
        total = [int(t) for t in (rows if most * n < 2**62 else rows.astype(object)).sum(axis=0)]
        centred = rows.astype(np.float64) - np.array([t / n for t in total])
    else:
        total = rows.sum(axis=0).tolist()
        centred = rows - np.array(total) / n
    if n > rows.shape[1]:  # the triangle has the same singular values and right vectors
        centred = np.linalg.qr(centred, mode="r")
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    return Summary(n, total, s, vt)


def merged(a: Summary | None, b: Summary) -> Summary:
    """Summary of both sets of rows."""
    if a is None:
        return b
    n = a.n + b.n
    apart = np.array([(y * a.n - x * b.n) / (a.n * b.n) for x, y in zip(a.total, b.total, strict=True)])
    correction = np.sqrt(a.n * b.n / n) * apart
    _, s, vt = np.linalg.svd(np.vstack([a.s[:, None] * a.vt, b.s[:, None] * b.vt, correction]), full_matrices=False)
    return Summary(n, [x + y for x, y in zip(a.total, b.total, strict=True)], s, vt)


def _to_batch(part: int, x: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([x.n], pa.int64()), pa.array([[repr(t) for t in x.total]], pa.list_(pa.string())), pa.array([x.s.tolist()], pa.list_(pa.float64())), pa.array([x.vt.ravel().tolist()], pa.list_(pa.float64()))],
        ["part", "n", "total", "s", "vt"],
    )


def _from_row(row: dict) -> Summary:
    total = [float(t) if set(t) & set(".en") else int(t) for t in row["total"]]
    return Summary(row["n"], total, np.array(row["s"]), np.array(row["vt"]).reshape(-1, len(total)))


def _matrices(batches, column: str, dims: int):
    """(batch, rows of whole numbers without the offset) a few at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims) - OFFSET


def summarise(rows: DataFrame, dims: int, transform=None) -> Summary | None:
    """Summary of all rows of ``x``, lists of ``dims`` lattice numbers; ``transform`` maps a
    block of them, without the offset, to rows of doubles. None without rows."""

    def leaf(batches):
        held = None
        for _, y in _matrices(batches, "x", dims):
            if len(y):
                held = merged(held, of_rows(transform(y) if transform else y))
        if held is not None:
            yield _to_batch(TaskContext.get().partitionId(), held)

    def merge(table: pa.Table) -> pa.Table:
        held, part = None, min(table["part"].to_pylist())
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            held = merged(held, _from_row(row))
        return pa.Table.from_batches([_to_batch(part // FAN_IN, held)])

    parts, left = rows.select("x").mapInArrow(leaf, SUMMARY), rows.rdd.getNumPartitions()
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, SUMMARY)
        left = -(-left // FAN_IN)
    found = parts.toArrow().to_pylist()  # one row, or none
    return _from_row(found[0]) if found else None


@dataclass
class Whitener:
    """Exact sums without the offset, and components by falling eigenvalue."""

    n: int
    total: list[int]
    values: np.ndarray  # eigenvalues of the covariance
    trace: float
    components: np.ndarray  # (k, dims)
    identity_error: float = 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - total, in whole numbers of any size."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.total))
        if most < 2**62:
            return self.n * y - np.array(self.total, np.int64)
        return self.n * y.astype(object) - np.array(self.total, object)

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares; None past a long's range."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * centred.shape[1] < 2**63:
            return (centred * centred).sum(axis=1).tolist()
        exact = (centred.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def __call__(self, centred: np.ndarray) -> np.ndarray:
        return ((centred / self.n).astype(np.float64) @ self.components.T) / np.sqrt(self.values)


def lattice(vectors: DataFrame, by: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows whose vector has entries, all of them finite and whole
    numbers on the lattice that a double tells apart: x = floor(scale * c) + OFFSET."""
    entries = F.col(column).cast("array<double>")
    steps = lambda c: c * float(scale)
    whole = lambda c: F.coalesce(F.abs(steps(c)) < EXACT, F.lit(False)) & ~F.isnan(c)
    rows = vectors.select(F.col(by).cast("long").alias("vec_id"), entries.alias("c")).where((F.size("c") > 0) & F.forall("c", whole))
    on: Column = F.transform("c", lambda c: F.floor(steps(c)).cast("long") + OFFSET)
    return rows.select("vec_id", on.alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitener | None, int]:
    """Whitener of the distinct vectors of ``rows``, and their length. Components without
    variance are left out, so there may be fewer."""
    spark = rows.sparkSession
    distinct = common.cut(rows.select("x").distinct(), "lattice")
    sizes = distinct.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "dims")).alias("m")).first()["m"]
    if most is None:
        return None, 0
    dims = most["dims"]
    used = distinct.where(F.size("x") == dims)
    all_of = summarise(used, dims)
    k = min(components, int((all_of.s > LEAST_SHARE * all_of.s[0]).sum()))
    side = np.sign(all_of.vt[np.arange(k), np.abs(all_of.vt[:k]).argmax(axis=1)])
    power = all_of.s**2 / all_of.n
    found = Whitener(all_of.n, all_of.total, power[:k], float(power.sum()), all_of.vt[:k] * side[:, None])
    if k:
        shared = spark.sparkContext.broadcast(found)
        again = summarise(used, dims, lambda y: shared.value(shared.value.centred(y)))
        gap = again.vt.T @ ((again.s**2 / again.n)[:, None] * again.vt) - np.eye(k)
        found.identity_error = float(np.abs(gap).max())
    return found, dims


def whiten(vectors: DataFrame, by: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    remaining row of ``vectors`` and each component.

    Null and empty vectors and those with null, non-finite or too large entries (2^53 steps)
    take no part, nor do those of another length than most distinct vectors have (ties: the
    larger length). Repeated vectors count once in the fit and get their rows each; null and
    repeated ids are kept. Components without variance are left out: equal vectors give no
    rows, nor does an empty table. A ``deviation`` past a long's range is null. Other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = lattice(vectors, by, column, scale)
    model, dims = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.values.size:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        k = m.values.size
        for batch, y in _matrices(batches, "x", dims):
            if not len(y):
                continue
            centred = m.centred(y)
            each = pa.array(np.repeat(np.arange(len(y)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(k * len(y), m.n, np.int64)),
                    pa.array(m.deviation(centred), pa.int64()).take(each),
                    pa.array(m(centred).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(y))),
                    pa.array(np.full(k * len(y), m.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == dims).mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of all embeddings."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
