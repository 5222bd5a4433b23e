import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.components import components


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs, radius=4):
    """component (smallest id) of each (id, fingerprint)."""
    n, parent = len(pairs), list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin((pairs[i][1] ^ pairs[j][1]) & (2**64 - 1)).count("1") <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(pairs[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(n)]


def prints(spark, seed=3):
    rng = random.Random(seed)
    fps = [0, 1, 3, 7, 15, 31, 63, 127, 255, 2**64 - 1]
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    ids = rng.sample(range(10**6), len(fps))
    return list(zip(ids, fps)), spark.createDataFrame(pd.DataFrame({"doc_id": ids, "fp": np.array(fps, np.uint64).view(np.int64)}))


@pytest.mark.parametrize("options", [{}, {"parts": 2}, {"parts": 4}, {"bucket_max": 5}, {"radius": 1}, {"radius": 6, "bucket_max": 3}, {"radius": 7, "parts": 4}])
def test_groups_are_those_of_all_pairs(spark, options):
    pairs, df = prints(spark)
    want = {f: c for (_, f), c in zip(pairs, brute(pairs, options.get("radius", 4)))}
    got = {r["fp"] & (2**64 - 1): r["component_id"] for r in simhash.near_groups(df, **options).collect()}
    assert got == want


def test_whole_table_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    want = {(d, format(f, "016x"), c) for (d, f), c in zip(fps, brute(fps))}
    assert {tuple(r) for r in simhash.simhash_groups(docs).collect()} == want


def test_odd_rows(spark, odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6, None)} == {5}


def words_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1))))


def copy_roots(texts, least=0.8):
    """Group number of each text: transitive links of a Jaccard similarity of 0.8 or more."""
    sets, parent = [words_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both >= least * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_near_copies_are_those_of_all_pairs(spark, docs):
    rng = random.Random(8)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for t in [x for x in texts if x and len(x.split()) >= 60][:40]:  # copies with a few words changed
        w = t.split()
        for _ in range(2):
            c = list(w)
            for _ in range(max(1, len(w) // rng.choice((60, 200)))):
                c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, got = copy_roots(texts), {r["doc_id"]: r["root"] for r in simhash.near_copies(rows).collect()}
    assert len(got) == len(texts)
    together = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    found = sum(got[i] == got[j] for i, j in together)
    assert len(together) > 60 and found >= 0.95 * len(together)
    groups = {}
    for i, r in got.items():
        groups.setdefault(r, set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values())  # never two groups in one
    assert simhash.one_per_group(rows).count() == len(groups)


def test_a_large_group_of_copies_in_blocks(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        c = list(base)
        c[rng.randrange(400)] = "x"
        texts.append(" ".join(c))
    rows = spark.createDataFrame([*enumerate(texts), (900, "nothing of the kind is in here at all")], "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(rows, bucket_max=7).collect()}
    assert len({got[i] for i in range(60)}) == 1 and got[900] != got[0]


def chain(rng, length, words=300, share=0.85):
    """Texts whose neighbours have about that similarity, others less: a window over words."""
    step = round((words - 4) * (1 - share) / (1 + share))
    w = [f"w{rng.randrange(10**7)}" for _ in range(words + step * length)]
    return [" ".join(w[i * step : i * step + words]) for i in range(length)]


def groups_of(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["root"] for r in simhash.near_copies(rows, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"bucket_max": 7}, {"group_bytes": 20_000}, {"bucket_max": 7, "group_bytes": 1}])
def test_chains_keep_their_links(spark, options):
    """Neighbours in a chain are linked, its ends aren't: links have to be those that were
    seen. The index may miss a few links, so groups may be cut, never joined."""
    rng = random.Random(5)
    texts = [t for n in (12, 25, 25, 25, 25, 25, 25) for t in chain(rng, n)]
    want, got = copy_roots(texts), groups_of(spark, texts, **options)
    assert len(set(want)) == 7
    assert all(len({want[i] for i in got if got[i] == r}) == 1 for r in set(got.values()))
    assert len(set(got.values())) <= 8  # pairs at 0.85 meet with a probability of 0.998


def test_every_option_gives_the_same_groups(spark):
    """Copies of one base, chains and a cluster of texts that are alike but under 0.8, dense
    enough for several rounds; groups don't depend on how buckets are worked off."""
    rng = random.Random(6)
    base = [f"b{rng.randrange(10**7)}" for _ in range(300)]
    texts = chain(rng, 40)
    for k in range(40):  # pairs at 0.5 to 0.7: dense buckets, no links
        w = list(base)
        for i in rng.sample(range(300), 9):
            w[i] = f"x{k}-{i}"
        texts.append(" ".join(w))
    for k in range(60):
        w = list(base)
        w[k * 5] = f"y{k}"
        texts.append(" ".join(w))
    first = groups_of(spark, texts)
    same = lambda got: {frozenset(i for i in got if got[i] == r) for r in got.values()}
    for options in ({"group_bytes": 9_000}, {"bucket_max": 9}, {"bucket_max": 30, "group_bytes": 50_000}):
        assert same(groups_of(spark, texts, **options)) == same(first)
    want = dict(enumerate(copy_roots(texts)))
    assert all(len({want[i] for i in g}) == 1 for g in same(first))
    assert len(same(first)) <= len(same(want)) + 1


def test_groups_are_verified_in_blocks(spark):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50)))) for _ in range(60)] + [np.arange(40 + i) for i in range(12)] + [np.zeros(0, np.int64)]
    sets = [x.astype(np.int64) * 0x9E3779B97F4A7 for x in sets]
    root = [int(i % 3) for i in range(len(sets))]
    rows = [(root[i], i, x.tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame([*rows, rows[5]], "root long, node long, shingles array<long>").repartition(4)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = np.intersect1d(a, sets[j]).size
            if root[i] == root[j] and both >= 0.8 * (a.size + sets[j].size - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(sets)) if sum(find(j) == find(i) for j in range(len(sets))) > 1}
    assert len(set(want.values())) >= 3
    for size in (1, 1_000, 1_000_000):
        links = simhash.verified(df, 0.8, size)
        assert {r["node"]: r["root"] for r in components(links).collect()} == want


def test_one_per_group(spark, odd):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 4, 5, 7, 8, 9]


def test_empty_table(none):
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.one_per_group(none).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(7, 7), (201, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == 100 for n in range(100, 161)) and all(got[n] == 7 for n in range(200, 260))
