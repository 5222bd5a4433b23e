"""Ridge solvers: direct, block conjugate gradients, power iteration.

Matrices are NumPy arrays whose sizes follow from the number of features and targets.
:func:`column_cg` spreads the right-hand side's columns over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Below this a denominator counts as zero.
TINY = 1e-30


@dataclass
class Result:
    x: np.ndarray
    iterations: int
    residual: float
    converged: bool


def add_ridge(a: np.ndarray, ridge: float) -> np.ndarray:
    return a + ridge * np.eye(len(a))


def direct(a: np.ndarray, b: np.ndarray) -> Result:
    return Result(np.linalg.solve(a, b), 0, 0.0, True)


def _safe_ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """0 where the denominator is zero for its precision."""
    ok = np.abs(bottom) > max(TINY, np.finfo(bottom.dtype).tiny)
    return np.divide(top, bottom, out=np.zeros_like(top), where=ok)


def single_cg(a: np.ndarray, b: np.ndarray, tol: float = 1e-5, **options) -> Result:
    """:func:`block_cg` in single precision, to the looser tolerance that allows."""
    return block_cg(a.astype(np.float32), b.astype(np.float32), tol=tol, **options)


def block_cg(a: np.ndarray, b: np.ndarray, x0: np.ndarray | None = None, tol: float = 1e-6, max_iter: int = 1000, preconditioner: str | None = "diagonal", scale: float | None = None) -> Result:
    """Conjugate gradients of all columns at once, sharing the product with ``a``.

    Stops when the largest column residual is under ``tol`` times ``scale``, the largest
    initial one unless given. All-zero right-hand sides give zeros at once.
    """
    one = b.ndim == 1
    rhs = b[:, None] if one else b
    x = np.zeros_like(rhs) if x0 is None else (x0[:, None] if one else x0).astype(rhs.dtype).copy()

    def done(iterations: int, residual: float, converged: bool) -> Result:
        return Result(x[:, 0] if one else x, iterations, residual, converged)

    if not rhs.any():
        x[:] = 0
        return done(0, 0.0, True)
    if preconditioner == "diagonal":
        d = np.diag(a).copy()
        d[np.abs(d) < max(TINY, np.finfo(d.dtype).tiny)] = 1
        invert = (1 / d)[:, None].astype(rhs.dtype)
    elif preconditioner in (None, "none"):
        invert = 1.0
    else:
        raise ValueError(f"unknown preconditioner: {preconditioner}")
    r = rhs - a @ x
    level = float(np.linalg.norm(r, axis=0).max()) if scale is None else scale
    worst = float(np.linalg.norm(r, axis=0).max())
    if worst <= tol * level and worst == 0:
        return done(0, 0.0, True)
    z = invert * r
    p, rz = z.copy(), (r * z).sum(axis=0)
    for k in range(1, max_iter + 1):
        ap = a @ p
        step = _safe_ratio(rz, (p * ap).sum(axis=0))
        x += step * p
        r -= step * ap
        worst = float(np.linalg.norm(r, axis=0).max())
        if worst < tol * level:
            return done(k, worst / level, True)
        z = invert * r
        now = (r * z).sum(axis=0)
        p = z + _safe_ratio(now, rz) * p
        rz = now
    return done(max_iter, worst / level, False)


def spectral_radius(a: np.ndarray, steps: int = 50, seed: int = 42) -> float:
    """Largest eigenvalue of a symmetric positive matrix by the power method."""
    v = np.random.default_rng(seed).standard_normal(len(a))
    size = 0.0
    for _ in range(steps):
        w = a @ v
        size = float(np.linalg.norm(w))
        if size == 0:
            return 0.0
        v = w / size
    return float(v @ (a @ v))


def power(a: np.ndarray, b: np.ndarray, ridge: float, tol: float = 1e-6, max_iter: int = 10_000) -> Result:
    """Richardson iteration for (a + ridge I) x = b; ``a`` has no ridge yet.

    ``a`` is scaled by its largest eigenvalue s; x then solves (a/s + ridge/s) x = b/s,
    and needs no scaling back.
    """
    s = spectral_radius(a) or 1.0
    m, c, lam = a / s, b / s, ridge / s
    step, x = 1 / (1 + lam), np.zeros_like(b)
    goal = tol * float(np.linalg.norm(c))
    for k in range(1, max_iter + 1):
        change = step * (c - m @ x - lam * x)
        x = x + change
        size = float(np.linalg.norm(change))
        if size <= goal:
            return Result(x, k, size, True)
    return Result(x, max_iter, size, False)


def condition_number(a: np.ndarray, largest: int = 4096) -> float | None:
    return float(np.linalg.cond(a)) if len(a) <= largest else None


def solve(a: np.ndarray, b: np.ndarray, solver: str = "direct", ridge: float | None = None, **options) -> Result:
    """``a`` with its ridge added; ``power`` needs the ridge to take it off again."""
    if solver == "direct":
        return direct(a, b)
    if solver == "cg":
        return block_cg(a, b, **options)
    if solver == "cg32":
        return single_cg(a, b, **options)
    if solver == "power":
        if ridge is None:
            raise ValueError("power needs the ridge")
        return power(a - ridge * np.eye(len(a)), b, ridge, **options)
    raise ValueError(f"unknown solver: {solver}")


def column_cg(spark: SparkSession, a: np.ndarray, b: np.ndarray, tol: float = 1e-6, max_iter: int = 1000, groups: int | None = None) -> DataFrame:
    """(column, x, iterations): each task solves a group of columns against the broadcast
    ``a``, measured against the largest column of all of ``b``."""
    scale = float(np.linalg.norm(b, axis=0).max()) or 1.0
    shared = spark.sparkContext.broadcast(a)
    rows = spark.createDataFrame([(j, b[:, j].tolist()) for j in range(b.shape[1])], "column int, b array<double>")
    rows = rows.repartition(groups or spark.sparkContext.defaultParallelism, "column")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rhs = batch.column("b").flatten().to_numpy().reshape(batch.num_rows, -1).T
                done = block_cg(shared.value, rhs, tol=tol, max_iter=max_iter, scale=scale)
                yield pa.RecordBatch.from_arrays([batch.column("column"), pa.array(done.x.T.tolist()), pa.array(np.full(batch.num_rows, done.iterations, np.int32))], ["column", "x", "iterations"])

    return rows.mapInArrow(run, "column int, x array<double>, iterations int")


def generate_problem(features: int, targets: int = 1000, rows: int | None = None, seed: int = 42, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Seeded Gaussian features times 0.1 and random labels, as (A with ridge, B)."""
    n = rows or max(2 * features, 5000)
    # The benchmark's random stream and scale.
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, features)) * 0.1
    label = rng.integers(0, targets, n)
    b = np.zeros((features, targets))
    np.add.at(b.T, label, z)
    return add_ridge(z.T @ z, ridge), b


def neumann(m: np.ndarray, b: np.ndarray, tol: float = 1e-12, max_iter: int = 10_000) -> Result:
    """(I - m)^-1 b as the sum of m^k b, for a spectral radius under 1."""
    term, total = b.astype(np.float64), b.astype(np.float64).copy()
    goal = tol * max(float(np.linalg.norm(b)), TINY)
    for k in range(1, max_iter + 1):
        term = m @ term
        total += term
        size = float(np.linalg.norm(term))
        if size <= goal:
            return Result(total, k, size, True)
    return Result(total, max_iter, size, False)


def absorber(m: np.ndarray) -> np.ndarray:
    """Stochastic completion of a substochastic matrix: missing column mass is spread
    evenly by a rank-one term."""
    missing = 1 - m.sum(axis=0)
    return m + np.full((len(m), 1), 1 / len(m)) @ missing[None, :]


def pagerank(p: np.ndarray, damping: float = 0.85, tol: float = 1e-12, max_iter: int = 1000) -> np.ndarray:
    """Stationary vector of damping * p + (1 - damping)/n, by power iteration."""
    v = np.full(len(p), 1 / len(p))
    for _ in range(max_iter):
        w = damping * (p @ v) + (1 - damping) / len(p)
        if np.abs(w - v).sum() < tol:
            return w
        v = w
    return v
