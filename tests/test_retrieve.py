"""Search by upper bounds against scores of all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import retrieve, vocab
from sparkloom.sources import tables


def corpus(spark, n=300, q=25, seed=3):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 400)}"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60))))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(min(n, 20))]  # equal entries: ties
    asked = [(i, " ".join(word() for _ in range(int(rng.integers(0, 15))))) for i in range(q)] + [(900, "nothing known"), (901, None)]
    counts = tables.cut(vocab.row_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), "counts")
    weights = vocab.idf(vocab.document_frequency(counts), len(docs))
    queries = retrieve.tfidf(vocab.row_counts(spark.createDataFrame(asked, "doc_id long, text string")), weights).withColumnRenamed("doc_id", "query_id")
    return tables.cut(queries, "queries"), tables.cut(retrieve.weighted(counts, weights).withColumnRenamed("doc_id", "entry_id"), "entries")


def same(got, want):
    key = lambda rows: {(r["query_id"], r["rank"]): r for r in rows}
    got, want = key(got), key(want)
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["entry_id"] == r["entry_id"]
        assert np.allclose([got[k][c] for c in ("kw_raw", "s_kw", "cosine", "score")], [r[c] for c in ("kw_raw", "s_kw", "cosine", "score")])


@pytest.mark.parametrize("k, tokens", [(1, 1_000_000), (3, 1_000_000), (5, 40)])
def test_search_is_the_best_of_all_pairs(spark, k, tokens):
    queries, entries = corpus(spark)
    want = retrieve.best(retrieve.score(queries, entries), k).collect()
    assert len(want) > 20 * k
    same(retrieve.search(queries, entries, k, tokens).collect(), want)


def test_most_pairs_are_not_scored(spark, sf_dir):
    """What is left out is left out by bounds, whatever the blocks' order."""
    queries, entries = corpus(spark, n=3_000, q=40)
    asked = retrieve.Asked(queries.select("query_id", "token", "idf", "unit").toArrow())
    finder = retrieve.Finder(asked, 3)
    rows = retrieve.index(entries).toArrow().combine_chunks().to_batches()
    for batch in rows:
        for at in range(0, batch.num_rows, 100):
            finder.see_batch(batch.slice(at, 100))
    met = retrieve.score(queries, entries).count()
    assert finder.scored < 0.2 * met
    best = retrieve.best(retrieve.score(queries, entries), 3).collect()
    want = {}
    for r in best:
        want.setdefault(r["query_id"], []).append((r["rank"], r["entry_id"]))
    got = {asked.ids[j].as_py(): [x[1] for x in sorted(b, key=lambda x: x[:2])] for j, b in enumerate(finder.best) if b}
    assert got == {q: [e for _, e in sorted(v)] for q, v in want.items()}


def test_no_queries_and_no_entries(spark):
    queries, entries = corpus(spark, n=5, q=2)
    assert retrieve.search(queries.limit(0), entries).count() == retrieve.search(queries, entries.limit(0)).count() == 0
    assert isinstance(retrieve.Asked(queries.limit(0).select("query_id", "token", "idf", "unit").toArrow()).ids, pa.Array)


def test_blocks_are_bounded_by_meetings(spark, monkeypatch):
    """Frequent tokens that most queries have: no block makes more than its share of meetings or
    rows, and the result is that of all pairs."""
    queries, entries = corpus(spark, n=400, q=60)
    want = retrieve.best(retrieve.score(queries, entries), 2).collect()
    asked = retrieve.Asked(queries.select("query_id", "token", "idf", "unit").toArrow())
    monkeypatch.setattr(retrieve, "BLOCK_CELLS", 200)
    most, whole, bincount = [], retrieve.Finder(asked, 2), np.bincount
    monkeypatch.setattr(retrieve.np, "bincount", lambda x, *a, **k: (most.append(len(x)), bincount(x, *a, **k))[1])
    for batch in retrieve.index(entries).toArrow().combine_chunks().to_batches():
        whole.see_batch(batch)
    entry_most = asked.query.size  # an entry meets each token of each query once at most
    assert max(most) <= max(200, entry_most)
    monkeypatch.undo()
    got = {asked.ids[j].as_py(): [x[1] for x in b] for j, b in enumerate(whole.best) if b}
    ranked = {}
    for r in sorted(want, key=lambda r: r["rank"]):
        ranked.setdefault(r["query_id"], []).append(r["entry_id"])
    assert got == ranked


def test_entries_cross_batches(spark):
    """Rows of one entry in several batches are one entry."""
    queries, entries = corpus(spark, n=100, q=10)
    asked = retrieve.Asked(queries.select("query_id", "token", "idf", "unit").toArrow())
    one, many = retrieve.Finder(asked, 3), retrieve.Finder(asked, 3)
    rows = retrieve.index(entries).toArrow().to_pylist()
    place = {w: i for i, w in enumerate(asked.words.to_pylist())}
    flat = [(r["entry_id"], place[t], x) for r in sorted(rows, key=lambda r: r["entry_id"]) for t, x in zip(r["tokens"], r["impacts"], strict=True) if t in place]
    table = pa.table(dict(zip(("entry_id", "word", "impact"), map(list, zip(*flat, strict=True)), strict=True)))
    one.see_rows(table.to_batches())
    many.see_rows(table.to_batches(max_chunksize=3))
    assert [sorted(x[:2] for x in b) for b in one.best] == [sorted(x[:2] for x in b) for b in many.best]
    assert sum(map(len, one.best)) > 20
