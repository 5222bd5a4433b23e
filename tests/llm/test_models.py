import zlib

import numpy as np

from sparkloom.llm import ann, langid, toxicity


def test_language_held_out(spark, docs, sf_dir):
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r for r in held if r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in judged) >= 0.95 * len(judged)


def test_language_of_odd_rows(odd, none, docs):
    rows = langid.predictions(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert by[4]["lang_pred"] in ("en", "de")
    assert langid.predictions(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none.select("doc_id", "text", "lang"))).collect()} == {"und"}


def plain_grams(text):
    """Buckets of the n-grams of a text, one character at a time."""
    folded, last = [32], 32
    for c in f"{text} ":
        code = ord(c.lower()[0]) if c.isalpha() else 32
        if code != 32 or last != 32:
            folded.append(code)
        last = code
    for order in langid.ORDERS:
        for i in range(len(folded) - order + 1):
            h = sum(x * int(m) for x, m in zip(folded[i : i + order], langid.MIX)) % 2**32
            yield ((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> (32 - langid.BITS)


TEXTS = ("The thing.", "a", "Été là", "x" * 500 + " y", "  two  spaces, 3 numbers ")


def test_language_sums_are_plain_naive_bayes(docs):
    model = langid.train(docs.select("doc_id", "text", "lang"))
    for most in (1, 3, 10, langid.PORTION):  # long texts go piece by piece
        best, share, some = model.score(list(TEXTS), most)
        for k, text in enumerate(TEXTS):
            z = sum(model.matrix[:, b].astype(np.float64) for b in plain_grams(text)) + model.prior
            p = np.exp(z - z.max())
            assert best[k] == z.argmax() and abs(share[k] - (p / p.sum()).max()) < 1e-6 and some[k]


def test_language_counts_are_plain(spark):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({l for _, _, l in rows})
    for k, l in enumerate(model.languages):
        count = np.full(langid.BUCKETS, langid.SMOOTHING)
        for _, text, lang in rows:
            for b in plain_grams(text) if lang == l else ():
                count[b] += 1
        assert np.allclose(model.matrix[k][:-1], np.log(count / count.sum()), atol=1e-5)


def plain_score(scorer, text):
    """Score of a text, a word at a time."""
    words = {w for w in "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()}
    found = {toxicity.word_feature(w) for w in words}
    for kind, size in enumerate(toxicity.PREFIXES, 1):
        found |= {int(f) for w in words if len(w) >= size for _, k, c in toxicity.features([w]) for f in c[k == kind]}
    z = scorer.bias + sum(w for c, w in zip(scorer.known.codes.tolist(), scorer.weight) if c in found)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_held_out(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.predictions(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_surface_votes():
    masked = toxicity.SURFACE.index("masked word")
    for text in ("oh f*** off", "s**t", "you i@#$%", "(f***)"):
        assert toxicity.surface(text, 0)[masked] == 1
    for text in ("", "2 ** 3", "el.*** En%%%", "a * b", "list*** of", "C# and F#", "x=*args", "**bold**"):
        assert toxicity.surface(text, 0)[masked] == -1
    assert not {toxicity.word_feature(w) for w in ("die", "der", "la", "mit")} & {int(c) for codes in toxicity.lexicons().values() for c in codes}


def test_toxicity_on_held_out_rows_only(spark):
    sf = "/root/testdata/sf0.1"  # enough held-out rows for both classes
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, other = [r for r in known if r["toxic"] == 1], [r for r in known if r["toxic"] == 0]
    hit, false = sum(r["predicted"] for r in toxic), sum(r["predicted"] for r in other)
    assert len(toxic) >= 50 and hit >= 0.7 * len(toxic) and false <= 0.01 * len(other)
    assert hit >= 0.95 * (hit + false) and len(other) - false >= 0.95 * (len(other) - false + len(toxic) - hit)


def test_toxicity_scores_are_plain(spark, docs, odd, sf_dir):
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for df in (docs, odd):
        texts = [(r["text"] or "")[:20_000] for r in df.collect()]
        assert np.allclose(scorer.score(texts), [plain_score(scorer, t) for t in texts], atol=1e-9)
    long = "a kind word and an idiot " * 50
    assert np.allclose(scorer.score([long]), toxicity.Scorer(scorer.known, scorer.weight, scorer.bias).score([long]))
    whole = [set(map(tuple, zip(k.tolist(), f.tolist()))) for _, k, f in toxicity.features([long])]
    pieces = [set(map(tuple, zip(k.tolist(), f.tolist()))) for _, k, f in toxicity.features([long], 40)]
    assert set().union(*whole) == set().union(*pieces)


def test_words_that_differ_at_the_end_are_two_features():
    a = "a" * 40
    assert toxicity.word_feature(a + "b") != toxicity.word_feature(a + "c")
    assert toxicity.word_feature("Idiot") == toxicity.word_feature("idiot!")


def test_mined_features_have_no_cap(spark):
    marks = " ".join(f"mark{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(650))
    rows = [(f"{'' if i % 2 else marks} plain words", 1 - i % 2, i % 5) for i in range(100)]
    scorer = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    assert scorer.known.codes.size > 650
    assert scorer.score([rows[0][0]])[0] > 0.5 > scorer.score(["plain words"])[0]


def test_toxicity_of_odd_rows(spark, odd, none, sf_dir):
    labels = spark.createDataFrame([(5, 0, 1), (5, 0, 0), (None, 0, 1), (6, 0, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.predictions(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.predictions(none, labels).count() == 0
    assert toxicity.predictions(odd, labels.limit(0)).count() == odd.count()


def test_lexicons_alone_decide_without_labels(spark):
    scorer = toxicity.fit(spark.createDataFrame([], "text string, toxic int, fold int"))
    low, high = scorer.score(["a kind word", "you worthless pathetic idiot"])
    assert low < 0.5 < high


def test_label_model_sees_through_voters_that_copy_each_other():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.2).astype(int)
    flip = lambda p: np.where(rng.random(4000) < p, 1 - truth, truth)
    bad = flip(0.35)
    votes = np.stack([flip(0.05), flip(0.12), flip(0.15), bad, bad, bad], axis=1)
    posterior, told = toxicity.label_model(votes)
    assert ((posterior > 0.5) == truth).mean() > 0.92 > ((votes.mean(axis=1) > 0.5) == truth).mean()
    hit = np.array(told["rates_1"])[:, 2]
    assert hit[0] > 0.85 and abs(hit[0] - 0.95) < 0.1 and np.abs(hit[3:] - 0.65).max() < 0.1  # accuracies
    tied = {(j, p) for j, p in enumerate(told["parent"]) if p >= 0}
    assert sum({j, p} <= {3, 4, 5} for j, p in tied) == 2  # the copies hang together


def brute(rows, k=10, every=100, dim=None):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == (dim or len(v)):
            ok[i] = np.array(v, np.float64)
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - ok[q]) ** 2).sum(axis=1))
        out[int(q)] = [(float(a), int(b)) for a, b in sorted(zip(d, ids)) if b != q][:k]
    return out


def check(df, least, dim=None):
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], dim=dim)
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = total = 0
    for q, near in want.items():
        mine = got.get(q, [])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        exact = {b: a for a, b in near}
        assert all(abs(exact.get(v, s) - s) < 1e-12 for _, s, v in mine)
        assert [(s, v) for _, s, v in mine] == sorted((s, v) for _, s, v in mine)
        hits += len({v for _, _, v in mine} & set(exact))
        total += len(near)
    assert set(got) <= set(want) and hits >= least * total
    return got


def test_recall_on_the_table(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)
    assert got and all(len(v) == 10 for v in got.values())


def test_what_a_cell_holds_does_not_follow_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((5, 16)) * 10
    rows = [(i, (centres[0 if i % 3 else i % 5] + rng.standard_normal(16)).tolist()) for i in range(3_000)]
    got = check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9)
    assert len(got) == 30 and all(len(v) == 10 for v in got.values())


def test_visits_and_meets_agree():
    rng = np.random.default_rng(3)
    index = ann.Index(rng.standard_normal((2, 8, 4)), rng.uniform(0, 3, (2, 4)), 3.0, 20)
    x, y = rng.standard_normal((6, 8)), rng.standard_normal((50, 8)) * 2
    codes, costs = index.visits(x)
    for t in range(2):
        near = index.meets(x, costs[:, :, -1].T, t, index.cells(y)[0][t])
        own = index.codes(index.cells(y)[0])[t]
        assert (near == np.array([[c in codes[t, q] for c in own] for q in range(6)])).all()


def test_vectors_that_take_no_part_ties_and_repeats(spark, none):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    rows += [(k, [1.0] * 8) for k in range(400, 440)] + [(400, [1.0] * 8)]
    rows += [(500, None), (600, []), (700, [0.0] * 8), (800, [float("nan")] * 8), (900, [1.0, None] * 4), (1000, [float("inf")] * 8), (None, [1.0] * 8), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = check(df, 0.9, 8)
    assert [v for _, s, v in got[400]] == list(range(401, 411)) and all(s == 0 for _, s, _ in got[400])
    assert not set(got) & {500, 600, 700, 800, 900, 1000, 1100}
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 400").limit(1)).count() == 0


def test_small_tables_and_outliers_find_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    tables = [[(100 * i, rng.standard_normal(16).tolist()) for i in range(n)] for n in (2, 3, 11)]
    far = [(i, (rng.standard_normal(16) * (20 if i % 50 == 0 else 1)).tolist()) for i in range(1000)]
    twice = [(7, (rng.standard_normal(16) + k).tolist()) for k in range(12)] + [(i, (rng.standard_normal(16) + 20).tolist()) for i in (100, 1, 2, 3)]
    for rows in (*tables, far):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = check(df, 0.9)
        want = brute(rows)
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    got = [r["vec_id"] for r in ann.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert sorted(got) == [1, 2, 3, 7]
