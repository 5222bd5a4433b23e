import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import queries, resample
from tests.oracle import spark_rows, sql_rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text, n=2):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in found]


def plain(rows, targets):
    """(doc_id, n_features, weight, score, rank) of rows in brute force."""
    have = [(d, *plain_runs(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in have for b in f), Counter(b for x in targets for b in plain_runs(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1_000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for d, words, f in have:
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, words, len(f), weight, weight + math.floor(-1_000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[2]))
    ranked = [(d, n, w, sc, r if r <= 25 * len(may) // 100 else None) for r, (d, _, n, w, sc) in enumerate(may, 1)]
    return sorted(ranked + [(d, n, w, sc, None) for d, words, n, w, sc in out if words < 20], key=repr)


def test_whole_table_is_its_sql_and_brute_force(spark, sf_dir, docs):
    got, columns = spark_rows(queries.queries()["op12_resample"](spark, sf_dir))
    want, names = sql_rows(resample.OP12_SQL, sf_dir)
    assert columns == names and got == want
    targets = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    order = [columns.index(c) for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r[i] for i in order) for r in got), key=repr) == plain(rows, targets)


@pytest.mark.parametrize("chunk", [1, 50, 65_536])
def test_odd_rows_in_chunks_of_any_size(spark, odd, chunk):
    targets = ["the same text appears", None, "", "wordy thing"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, own int")
    got = resample.resample(odd.withColumn("row", odd["n_chars"]), target, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got), key=repr) == plain([(r["doc_id"], r["text"]) for r in odd.collect()], targets)


def test_repeated_rows_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i % 5, text) for i in range(40)] + [(None, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.resample(df, df.where("doc_id = 1")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, [text] * 8)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))


def test_chunks_own_each_start_once():
    rng = np.random.default_rng(4)
    raw = b"".join(bytes(rng.choice(np.frombuffer(b"abcXYZ019 .,\n\xc3\xa4-", np.uint8), 1)) for _ in range(3_000)).replace(b"\xc3", b"").replace(b"\xa4", "ä".encode()) + b"x" * 500 + b" end"
    for n in (1, 2, 4):
        bounds = np.array([0, len(raw)])
        whole = resample.runs(np.frombuffer(raw, np.uint8), bounds, np.array([len(raw)]), n)
        assert Counter(whole[1].tolist()) == Counter(plain_runs(raw.decode(), n)[1])
        for size in (1, 7, 100, 10_000):
            cut = list(resample.chunks(raw, n, size))
            assert sum(own for _, own in cut) == len(raw)
            parts = [resample.runs(np.frombuffer(p, np.uint8), np.array([0, len(p)]), np.array([own]), n) for p, own in cut]
            assert sum((Counter(b.tolist()) for _, b, _ in parts), Counter()) == Counter(whole[1].tolist())
            assert sum(int(w[0]) for _, _, w in parts) == int(whole[2][0])


def test_empty_tables(spark, none):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(none, target).count() == 0
    docs = spark.createDataFrame([(1, "one two " * 20), (2, "three")], "doc_id long, text string")
    assert sorted(map(tuple, resample.resample(docs, target.limit(0)).collect())) == plain([(1, "one two " * 20), (2, "three")], [])
