"""Sums of vectors: what is shuffled is a place and a weight."""

import io
import re
from contextlib import redirect_stdout

import numpy as np

from sparkloom.operators import retrieve


def test_vectors_are_summed_where_a_document_lies(spark):
    rng = np.random.default_rng(5)
    rows = [(d, int(p), float(w)) for d in range(40) for p, w in zip(rng.integers(0, 30, 25), rng.random(25), strict=True)]
    vectors = rng.standard_normal((30, 4))
    weights = spark.createDataFrame(rows, "doc_id long, place int, w double").repartition(7, "place")
    found = retrieve.summed_vectors(weights, vectors)
    want = {}
    for d, p, w in rows:
        want[d] = want.get(d, 0) + w * vectors[p]
    got = {r["doc_id"]: np.array(r["vec"]) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[d], v / np.linalg.norm(v)) for d, v in want.items())
    with redirect_stdout(io.StringIO()) as said:
        found.explain()
    # the exchange by documents lies below the Python step, so that it makes one row a document
    plan = said.getvalue()
    assert re.search(r"MapInArrow[\s\S]*Exchange hashpartitioning\(doc_id", plan)


def test_vectors_beyond_the_bound_are_read_in_blocks(spark):
    """No vector goes with a token's row: the exchange of places lies below the Python step."""
    rng = np.random.default_rng(6)
    rows = [(d, int(p), float(w)) for d in range(40) for p, w in zip(rng.integers(0, 30, 25), rng.random(25), strict=True)]
    vectors = rng.standard_normal((30, 4)).astype(np.float32)
    weights = spark.createDataFrame([*rows, (1, None, 1.0)], "doc_id long, place int, w double").repartition(7, "place")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "place long, emb array<float>")
    found = retrieve.stored_vectors(weights, table, 4, block=7)
    want = {}
    for d, p, w in rows:
        want[d] = want.get(d, 0) + w * vectors[p].astype(float)
    got = {r["doc_id"]: np.array(r["vec"]) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[d], v / np.linalg.norm(v)) for d, v in want.items())
    with redirect_stdout(io.StringIO()) as said:
        found.explain()
    plan = said.getvalue()
    assert re.search(r"MapInArrow[\s\S]*Exchange hashpartitioning\(doc_id", plan) and "Join" not in plan
