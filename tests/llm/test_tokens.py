import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, common, encoding, packing, token_binary

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ALPHABET = list("aA1 '\n\t sStTrReEvVlLdDmM!.,%é  ß中٣²½ⅧİσςΣ́​\u0085\x1c😀가")


def library(name):
    return Tokenizer.from_file(common.tokenizer_path(name))


def texts(seed=5, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "<|endoftext|>", "a<|startoftext|> b<|endoftext|>c", "aaaaaaaa bbbb !!!!!!"]


@pytest.mark.parametrize("name", FILES)
def test_batch_encoder_is_the_library(name):
    enc, lib, rows = encoding.BatchEncoder(common.tokenizer_path(name), 2), library(name), texts()
    ids, bounds = enc.encode(rows)
    for i, e in enumerate(lib.encode_batch(rows, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*e.ids, 2]


@pytest.mark.parametrize("name", FILES)
def test_bpe_is_the_library(name):
    codec, lib, rows = bpe.Codec(common.tokenizer_path(name)), library(name), texts(6)
    for e, (n, raw, ids, shown) in zip(lib.encode_batch(rows, add_special_tokens=False), codec.encode(rows), strict=True):
        assert np.frombuffer(bytes(raw), "<i4").tolist() == e.ids and n == len(e.ids)
        assert bytes(ids[:-1]).decode() == " ".join(map(str, e.ids))
        assert bytes(shown[: len(shown) - len(codec.index.gap)]).decode() == lib.decode(e.ids, skip_special_tokens=False)
        assert codec.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


_CODEC, _LIB = bpe.Codec(common.tokenizer_path(FILES[1])), library(FILES[1])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    ((_, raw, _, _),) = _CODEC.encode([text])
    assert np.frombuffer(bytes(raw), "<i4").tolist() == _LIB.encode(text, add_special_tokens=False).ids


def plain(odd, name, end):
    lib = library(name)
    rows = [(r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids + end) for r in odd.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("bits", [False, True])
def test_shards_round_trip(spark, odd, bits):
    manifest = token_binary.write_shards(odd, common.fresh_path(spark, "t"), common.tokenizer_path(FILES[0]), 0, bits)
    got = sorted(token_binary.read_shards(manifest).collect(), key=lambda r: r["start"])
    want, start = plain(odd, FILES[0], [0]), 0
    assert len(got) == len(want)
    for g, (doc, ids) in zip(got, want, strict=True):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (doc, start, len(ids), crc)
        start += len(ids)
    row = manifest.orderBy("shard").first()
    reader = token_binary.ShardReader(row["path"])
    assert reader.ids(0, row["ids"]).size == row["ids"] and reader.ids(1, 3).size == 2


def test_damage_is_noticed(tmp_path):
    path = str(tmp_path / "x.ltok")
    w = token_binary.ShardWriter(path)
    w.block(np.arange(1000, dtype=np.uint32))
    w.close()
    data = bytearray(open(path, "rb").read())
    data[-FOOT] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(ValueError):
        token_binary.ShardReader(path)


FOOT = token_binary.FOOTER.size + 3


def test_digests(odd):
    lib = library(FILES[1])
    got = sorted(tuple(r) for r in bpe.bpe_digests(odd.na.fill({"doc_id": -1}), common.tokenizer_path(FILES[1])).collect())
    want = []
    for r in odd.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_encode_and_decode_columns(odd):
    v = common.tokenizer_path(FILES[1])
    rows = bpe.bpe_decode(bpe.bpe_encode(odd, v), v).collect()
    lib = library(FILES[1])
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == lib.decode(r["ids"], skip_special_tokens=False)


def test_packing(spark, odd):
    rows = packing.pack(odd, common.tokenizer_path(FILES[1])).collect()
    want = plain(odd, FILES[1], [2])
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, ids in want:
        own = [r for r in pieces[doc] if r["doc_tokens"] == len(ids)]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    check_sequences(rows)


def check_sequences(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and 0 < length
            at += length
        assert at <= capacity


def test_packing_the_table(docs):
    rows = packing.pack(docs, common.tokenizer_path(FILES[1])).collect()
    check_sequences(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    padding = (max(r["sequence_id"] for r in rows) + 1) * 4096 / sum(r["length"] for r in rows) - 1
    assert padding < 0.05


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_places_every_length(histogram):
    patterns, placed = packing.plan(histogram, 64), {}
    for count, lengths in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram


def test_empty_tables(spark, none):
    v = common.tokenizer_path(FILES[1])
    assert packing.pack(none, v).count() == 0
    assert bpe.bpe_digests(none, v).count() == 0
    assert token_binary.read_shards(token_binary.write_shards(none, common.fresh_path(spark, "t"), v)).count() == 0
