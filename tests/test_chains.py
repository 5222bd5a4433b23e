"""Sparse chains and exact medians against plain versions."""

import numpy as np
import pytest

from sparkloom.operators import evaluate, graph

EDGES = [(1, 2, 3.0), (1, 3, 1.0), (2, 3, 2.0), (3, 1, 1.0), (3, 4, 1.0), (1, 2, 1.0), (5, 1, 2.0), (2, None, 1.0), (6, 1, 0.0), (2, 5, -1.0)]


def matrix(size=7):
    w = np.zeros((size, size))
    for a, b, x in EDGES:
        if a is not None and b is not None and x > 0:
            w[a, b] += x
    return w / np.maximum(w.sum(1, keepdims=True), 1e-300)


@pytest.mark.parametrize("block", [1, 50_000])
def test_chain_is_the_dense_one(spark, block):
    df = spark.createDataFrame(EDGES, "a long, b long, w double").repartition(3)
    chain = graph.Chain(df, spark.createDataFrame([(9,), (None,)], "n long"), block)
    own = [1, 2, 3, 4, 5, 9]
    p = np.zeros((6, 6))
    p[:5, :5] = matrix()[np.ix_(own[:5], own[:5])]
    dangling = p.sum(1) == 0
    v = np.full(6, 1 / 6)
    for _ in range(8):
        v = 0.15 / 6 + 0.85 * (p.T @ v + v[dangling].sum() / 6)
    got = {r["node"]: r["rank"] for r in graph.pagerank(chain, rounds=8).collect()}
    assert np.allclose([got[k] for k in own], v) and abs(sum(got.values()) - 1) < 1e-12
    still = {r["node"]: r["rank"] for r in graph.pagerank(chain, rounds=200, tol=1e-9).collect()}
    full = p + dangling[:, None] / 6
    x = np.linalg.solve(np.eye(6) - 0.85 * full.T, np.full(6, 0.15 / 6))
    assert np.allclose([still[k] for k in own], x, atol=1e-8)
    for absorb, m in ((False, p), (True, full)):
        total = {r["node"]: r["total"] for r in graph.neumann(chain, rounds=60, absorb=absorb).collect()}
        assert np.allclose([total[k] for k in own], np.linalg.solve(np.eye(6) - 0.85 * m.T, np.full(6, 1 / 6)), atol=1e-4)


def test_empty_chain(spark):
    chain = graph.Chain(spark.createDataFrame([], "a long, b long, w double"))
    assert graph.pagerank(chain).count() == graph.neumann(chain).count() == 0


@pytest.mark.parametrize("options", [{}, {"most": 1, "pieces": 3}, {"most": 5, "pieces": 8}])
def test_exact_median(spark, options):
    rng = np.random.default_rng(3)
    rows = [("even", float(v)) for v in rng.standard_normal(100)] + [("odd", float(v)) for v in np.exp(30 * rng.standard_normal(101))]
    rows += [("tied", 7.0)] * 90 + [("tied", float(k)) for k in range(5)] + [("tied", 9.0)] * 3
    rows += [("high", 1.0)] * 3 + [("high", 5.0)] * 80 + [("two", 1.0), ("two", 4.0), ("one", 3.0), ("none", None), ("some", None), ("some", 2.0), (None, 1.0), (None, 2.0), (None, None)]
    got = {r["k"]: (r["median"], r["n"]) for r in evaluate.exact_median(spark.createDataFrame(rows, "k string, v double").repartition(3), "k", "v", **options).collect()}
    for k in {r[0] for r in rows}:
        values = [v for x, v in rows if x == k and v is not None]
        assert got[k][1] == sum(x == k for x, _ in rows)
        assert got[k][0] == (pytest.approx(float(np.median(values)), rel=1e-15) if values else None)
