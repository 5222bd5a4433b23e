import math

import numpy as np
import pytest

from sparkloom.llm import whitening


def plain(rows, k=16):
    """Brute force over (id, vector): n, deviations, components by falling eigenvalue."""
    used = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted(set(tuple(x) for _, x in used))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, total)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return used, n, total, values[order][:k], vectors[:, order][:, :k], np.trace(cov)


def check(got, rows, k=16):
    used, n, total, values, vectors, trace = plain(rows, k)
    assert len(got) == len(used) * min(k, len(values))
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(min(k, len(values))):
        want = np.array([[(n * c - s) / n for c, s in zip(x, total)] for _, x in used]) @ vectors[:, j] / math.sqrt(values[j])
        have = np.array([by[i, j + 1]["whitened"] for i, _ in used])
        assert np.allclose(have, want, atol=1e-7) or np.allclose(have, -want, atol=1e-7)
    for i, x in used:
        r = by[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, total))
        assert abs(r["explained"] - values[0] / trace) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_whole_table_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()]
    check(whitening.op13_whitening(spark, sf_dir).collect(), rows)
    # copies change nothing but their own rows
    again = table.union(table.where("vec_id % 3 = 0").selectExpr("vec_id + 100000", "embedding", "label")).repartition(7)
    check(whitening.whiten(again).collect(), rows + [(i + 100_000, v) for i, v in rows if i % 3 == 0])


def test_merging_is_lossless_in_any_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (300, 9)) * (10 ** np.arange(9) // 100 + 1)
    whole, parts = whitening.of_rows(rows), None
    for at in (0, 1, 2, 40, 200):
        parts = whitening.merged(parts, whitening.of_rows(rows[at : {0: 1, 1: 2, 2: 40, 40: 200, 200: 300}[at]]))
    assert parts.n == 300 and parts.total == rows.sum(axis=0).tolist()
    assert np.allclose(parts.s, whole.s, rtol=1e-12) and np.allclose(np.abs(np.sum(parts.vt * whole.vt, axis=1)), 1)


def test_more_partitions_than_one_merge_takes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((400, 5)))]
    x = whitening.lattice(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(40)
    got = whitening.summarise(x, 5)
    y = np.array([[math.floor(64 * c) for c in v] for _, v in rows])
    want = whitening.of_rows(y)
    assert got.n == 400 and got.total == y.sum(axis=0).tolist() and np.allclose(got.s, want.s, rtol=1e-12)


ODD = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [3.0, -1.0]), (7, [3.0, -1.0]), (None, [0.5, 0.25]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0]), (10, [-2.0, 5.0])]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in ODD], "vec_id long, embedding array<double>, component int, whitened double")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == sorted((i, c) for i in (-1, 1, 7, 7, 10) for c in (1, 2))
    assert {r["n"] for r in got} == {4}
    used, n, total, values, _, trace = plain([(i, v) for i, v in ODD if i in (None, 1, 7, 10)])
    assert {r["component"]: round(r["explained"], 9) for r in got} == {1: round(values[0] / trace, 9), 2: round(values[1] / trace, 9)}


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(-i)]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((5 * c - s) ** 2 for c, s in zip(v, total)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want
    assert {r["component"] for r in got} == {1}  # the other one has no variance


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 1.0])], [(1, [2.0]), (2, [2.0])], [(1, None)]])
def test_no_variance_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []
