import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluate, features, solvers, windows
from sparkloom.plans import queries


def problem(n=40, d=12, v=5, seed=0):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, d))
    return solvers.add_ridge(z.T @ z, 1e-2), rng.standard_normal((d, v))


def test_solvers_agree():
    a, b = problem()
    b[:, 2] = 0
    exact = solvers.solve(a, b).x
    for r in (solvers.solve(a, b, "cg", tol=1e-10), solvers.solve(a, b, "cg", tol=1e-10, preconditioner=None), solvers.solve(a, b, "power", ridge=1e-2, tol=1e-12)):
        assert r.converged and np.linalg.norm(r.x - exact) < 1e-5 * np.linalg.norm(exact)
    assert not solvers.block_cg(a, b * 0).x.any()
    one = solvers.block_cg(a, b[:, 0], tol=1e-10).x
    assert one.shape == (12,) and np.allclose(one, exact[:, 0], atol=1e-5)
    warm = solvers.block_cg(a, b, x0=exact, tol=1e-6, scale=float(np.linalg.norm(b, axis=0).max()))
    assert warm.iterations <= 1
    with pytest.raises(ValueError):
        solvers.solve(a, b, "other")
    with pytest.raises(ValueError):
        solvers.solve(a, b, "power")


def test_single_precision_and_neumann():
    a, b = problem()
    b[:, 2] = 0
    r = solvers.solve(a, b, "cg32")
    assert r.x.dtype == np.float32 and r.converged and np.allclose(a @ r.x, b, atol=1e-3) and not r.x[:, 2].any()
    assert not solvers.single_cg(a, b * 0).x.any()
    m = np.array([[0.5, 0.2], [0.1, 0.3]])
    assert np.allclose(solvers.neumann(m, np.ones(2)).x, np.linalg.solve(np.eye(2) - m, np.ones(2)))
    assert not solvers.neumann(np.eye(2), np.ones(2), max_iter=5).converged


def test_targets_by_tiles():
    rng = np.random.default_rng(5)
    z, w = rng.integers(-2, 3, (40, 4)).astype(float), rng.integers(-2, 3, (4, 50)).astype(float)
    score = z @ w
    want = np.array([sorted(range(50), key=lambda j: (-s[j], j))[:3] for s in score])
    for tile in (1, 7, 50, 99):
        value, top = features.top_targets(z, w, 3, tile)
        assert (top == want).all() and (value == np.take_along_axis(score, want, axis=1)).all()
    assert features.top_targets(z, w[:, :2], 3)[1].shape == (40, 2)


def test_nearest_of_keeps_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(99, [0.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>").orderBy(F.desc("id")).coalesce(1)
    got = features.nearest_of(df, [(7, [1.0, 1e-6]), (8, [0.0, 1.0])], 5, "id", "x").orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4] * 2
    assert features.nearest_of(df, [], 5, "id", "x").count() == 0


def test_cbow_brings_words_of_one_context_together(spark):
    rng = np.random.default_rng(0)
    groups = [[f"{g}{i}" for i in range(6)] for g in "ab"]
    rows = [([str(w) for w in rng.choice(groups[k % 2], 8)],) for k in range(300)] + [(["lonely"],), ([],), (None,)]
    found = features.cbow(spark.createDataFrame(rows, "sentence array<string>"), dims=8, window=4, rate=0.1)
    v = {r["word"]: np.array(r["vector"]) for r in found.collect()}
    assert set(v) == {"lonely", *groups[0], *groups[1]}
    unit = lambda w: v[w] / np.linalg.norm(v[w])
    near = np.mean([unit(x) @ unit(y) for g in groups for x in g for y in g if x != y])
    far = np.mean([unit(x) @ unit(y) for x in groups[0] for y in groups[1]])
    assert near > far + 0.5
    again = {r["word"]: r["vector"] for r in features.cbow(spark.createDataFrame(rows, "sentence array<string>"), dims=8, window=4, rate=0.1).collect()}
    assert all(np.allclose(again[w], v[w], atol=1e-5) for w in v)


def test_cbow_leaves_vectors_in_tasks(spark, monkeypatch):
    """No vector and no word passes through the driver, with several tasks too."""
    rng = np.random.default_rng(1)
    rows = [([f"w{w}" for w in rng.integers(0, 40, 500)],) for _ in range(900)]
    df = spark.createDataFrame(rows, "sentence array<string>")
    taken, to_arrow = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: (taken.extend(self.columns), to_arrow(self))[1])
    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (taken.append("made"), made(data, *a, **k))[1])
    found = features.cbow(df, dims=4, window=2, epochs=2)
    assert taken == ["i", "n"]
    got = {r["word"]: r["vector"] for r in found.collect()}
    assert len(got) == 40 and all(len(v) == 4 and np.isfinite(v).all() for v in got.values())


def test_spectrum():
    a, _ = problem()
    assert abs(solvers.spectral_radius(a, 500) - np.linalg.eigvalsh(a)[-1]) < 1e-6
    assert solvers.condition_number(a) > 1 and solvers.condition_number(a, largest=3) is None
    p = solvers.absorber(np.array([[0.5, 0.2], [0.1, 0.3]]))
    assert np.allclose(p.sum(axis=0), 1)
    rank = solvers.pagerank(p)
    assert np.allclose(0.85 * p @ rank + 0.15 / 2, rank, atol=1e-9)


def test_column_parallel_cg(spark):
    a, b = problem()
    rows = solvers.column_cg(spark, a, b, tol=1e-10, groups=3).collect()
    x = np.zeros_like(b)
    for r in rows:
        x[:, r["column"]] = r["x"]
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-6)


def test_windows_and_repeat(spark):
    for t in (24, 30, 100):
        toks = [f"t{i}" for i in range(t)]
        df = spark.createDataFrame(list(enumerate(toks)), "pos long, token string")
        long = toks * 5
        want = {}
        for i in range(len(long) - 24):
            key = (tuple(long[i : i + 24]), long[i + 24])
            want[key] = want.get(key, 0) + 1
        got = {(tuple(r["context"]), r["target"]): r["weight"] for r in windows.context_windows(df, t, repeat=5, block=32).collect()}
        assert got == want
        single = windows.context_windows(df, t, block=25).collect()
        assert sorted(r["start"] for r in single) == list(range(max(0, t - 24)))


def test_gram_and_prediction(spark):
    rng = np.random.default_rng(1)
    x, t, w = rng.standard_normal((200, 6)).astype(np.float32), rng.integers(0, 4, 200), rng.integers(1, 6, 200)
    df = spark.createDataFrame([(i, a.tolist(), int(b), int(c)) for i, (a, b, c) in enumerate(zip(x, t, w))] + [(900, None, 1, 1), (901, x[0].tolist(), None, 1)], "id int, x array<float>, target_id int, weight int").repartition(5)
    f = features.FourierMap.draw(6, 700, sigma=2.0)
    a, b = features.collect_gram(features.gram(df, f, weight="weight"), 700, 4)
    z = f(x)
    y = np.eye(4)[t]
    assert np.allclose(a, z.T @ (z * w[:, None])) and np.allclose(b, z.T @ (y * w[:, None]))
    assert np.allclose(a, a.T) and np.linalg.eigvalsh(a)[0] > -1e-8
    weights = solvers.solve(solvers.add_ridge(a, 1e-3), b).x
    for r in features.predict(df, weights, f, keep=("id",)).where("id < 900").collect():
        score = (z[r["id"]] @ weights).round(9)
        assert score[r["top"][0]] == score.max() and len(r["top"]) == 3


def test_fourier_kernel_and_encoder():
    f = features.FourierMap.draw(5, 20_000, sigma=1.5)
    x = np.random.default_rng(0).standard_normal((4, 5)) * 0.5
    z = f(x)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 1.5**2))
    assert np.abs(z @ z.T - k).max() < 0.05
    e = features.ContextEncoder(np.arange(6, dtype=np.float32).reshape(3, 2), slots=3)
    assert np.allclose(e(np.array([[0, 1, -1]])), [[0, 0.4, 2 * 0.7, 3 * 0.7, 0, 0]])


def test_incremental_gram(spark, tmp_path):
    from sparkloom.streaming import session

    rng = np.random.default_rng(3)
    x = rng.standard_normal((50, 4))
    spark.createDataFrame([(v.tolist(), i % 3) for i, v in enumerate(x)], "x array<double>, target_id int").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x array<double>, target_id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    session.accumulate_gram(stream, str(tmp_path / "out"), str(tmp_path / "cp"), features.gram).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    a, _ = features.collect_gram(features.add_slices(parts), 4, 3)
    assert np.allclose(a, x.T @ x)


def test_session_stream(spark, tmp_path, sf_dir):
    from sparkloom.operators import pairs
    from sparkloom.streaming import session

    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for k in range(3):  # turns arrive over several batches
        conv.where(F.floor(F.col("turn") % 100 / 2) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    conv.where(F.floor(F.col("turn") % 100 / 2) > 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(conv.schema).parquet(str(tmp_path / "in"))
    q = session.last_bot_stream(stream).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("turns").collect())
    assert got == sorted(tuple(r) for r in pairs.last_bot_turn(conv).collect())


def test_running_counts(spark, tmp_path, sf_dir):
    from sparkloom.streaming import session

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("token"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = session.running_counts(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_word2vec_query_trains_the_operators_epochs(spark, sf_dir, monkeypatch):
    train, asked = features.word2vec, []

    def spy(*args, **options):
        asked.append(inspect.signature(train).bind(*args, **options))
        asked[-1].apply_defaults()
        return train(*args, **options)

    monkeypatch.setattr(features, "word2vec", spy)
    rows = queries.QUERIES["word2vec"](spark, sf_dir).collect()
    assert [a.arguments["epochs"] for a in asked] == [20]
    assert rows and all(len(r["vector"]) == 32 for r in rows)


def test_bubbles_of_several_lines(spark):
    texts = ["\n ok .\n12w · 40% Top-3\nmatch: \"a\" kwRaw=3.5\nmatch: \"b\"", "x\nfallback kwMax=2.5 kwRaw=9", "hi\ngreeting: \"hallo\" kwRaw=1", "kwRaw=1.2.3 match: \"q\"", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r)[1:] for r in df.select("i", *evaluate.parse_bubble(F.col("t"))).orderBy("i").collect()]
    assert got == [("ok .", "b", 3.5, 40.0, 12, False), ("x", "", 2.5, 0.0, 0, True), ("hi", "hallo", 99.0, 0.0, 0, False), ('kwRaw=1.2.3 match: "q"', "q", 0.0, 0.0, 0, False), ("", "", 0.0, 0.0, 0, False), ("", "", 0.0, 0.0, 0, False)]
    one = spark.createDataFrame([("kwRaw=1.2.3",)], "l string").select(*evaluate.parse_response(F.col("l"))).first()
    assert one["kw_raw"] == 0.0


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "category string, passed boolean")
    of = lambda *x: tuple(evaluate.verdict(rows, *x).first())
    assert of("a") == (2, 2, 1.0, True, 0) and of("b") == (1, 0, 0.0, False, 1) and of(None)[3:] == (False, 1) and of(None, 0.6)[3:] == (True, 0) and of("none") == (0, 0, 0.0, False, 1)


def test_beyond_the_bounds_rows_are_joined_or_passed_again(spark, sf_dir, monkeypatch):
    want = {(r["doc_id"], r["dim"]): r["value"] for r in queries.bow_embedding(spark, sf_dir).collect()}
    monkeypatch.setattr(queries.retrieve, "VECTORS_BYTES", 0)
    monkeypatch.setattr(queries._embedded, "__defaults__", (0,))
    got = {(r["doc_id"], r["dim"]): r["value"] for r in queries.bow_embedding(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = [(r["vec_id"], list(r["embedding"])) for r in table.limit(7).collect()]
    one, two = ({(*r[:3], round(r[3], 9)) for r in features.nearest_of(table, asked, 4, "vec_id", "embedding", most).collect()} for most in (10_000, 3))
    assert one == two and len(one) == 28


@pytest.mark.parametrize("pivots, block", [(4, 2_000), (1, 7), (2, 3)])
def test_kernel_pairs_are_those_of_all(spark, pivots, block):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 5))
    x = np.concatenate([base[rng.integers(0, 12, 120)] + 0.25 * rng.standard_normal((120, 5)), base[:3], base[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (None, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 1.5**2))
    want = {(i, j): k[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if k[i, j] >= 0.9}
    fourier = features.FourierMap.draw(5, 2_048)
    got = features.kernel_pairs(df, "id", "x", 1.5, 0.9, fourier, pivots, block).collect()
    assert len(got) == len(want) > 100
    assert all(abs(want[r["a"], r["b"]] - r["kernel"]) < 1e-12 for r in got)
    assert np.mean([abs(r["product"] - r["kernel"]) for r in got]) < 0.02  # error of the features
    assert features.kernel_pairs(df.limit(0), "id", "x", 1.5, 0.9).count() == 0
