"""Byte-pair encoding and decoding with a pair occurrence index.

All new words of a chunk, a part of a partition that fits into memory, are merged
together. An index maps each adjacent pair, by its
merge rank, to the positions where it occurs; active ranks are applied in ascending
order from a heap, each to all its positions at once, and the neighbours' pairs move to
the lists of their new ranks. A merge can only make pairs of later ranks, so one pass
over the heap gives each word what merging it alone would give.

Words come from :mod:`pretokens`; a vocabulary file supplies ids and merges only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import common, encoding, pretokens

NO_RANK = np.int32(2**31 - 1)
#: Words a worker keeps with their ids, and their bytes; past either the cache starts anew.
CACHE_WORDS, CACHE_BYTES = 300_000, 16_000_000
#: Characters of text whose words share an index.
CHUNK_CHARS = 10_000_000


class PairIndex:
    """Ids, merges and ranks of a vocabulary file, and the merging of many words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocab, **self.added}.items()}
        #: Without a decoder tokens are joined by spaces; the byte-level decoder joins bytes.
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.gap = b"" if self.byte_level else b" "
        self.width = max(self.tokens) + 1
        letters = encoding.byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.twin = np.array([a == b for a, b in pairs])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NO_RANK where there is no such merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words aren't empty."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(size) - 1
        n = data.size
        sym = self.inner[data]
        sym[last] = self.final[data[last]]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[last] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[last[:-1] + 1] = -1
        alive, fresh = np.ones(n, bool), np.zeros(n, bool)
        rank = np.full(n, NO_RANK, np.int32)
        left = np.flatnonzero(after >= 0).astype(np.int32)
        rank[left] = self.rank(sym[left], sym[left + 1])

        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enlist(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks != NO_RANK
            places, ranks = places[known], ranks[known]
            if not places.size:
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cut.tolist(), ranks.size]
            for r, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r in lists:
                    lists[r].append(places[a:b])
                else:
                    lists[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        enlist(left, rank[left])
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if not at.size:
                continue
            if self.twin[r]:
                at = leftmost(np.sort(at), after)
            right = after[at]
            beyond = after[right]
            sym[at] = self.made[r]
            alive[right] = False
            rank[right] = NO_RANK
            after[at] = beyond
            some = beyond >= 0
            before[beyond[some]] = at[some]
            rank[at[~some]] = NO_RANK
            fresh[at] = True
            prior = before[at]
            prior = prior[prior >= 0]
            prior = prior[~fresh[prior]]
            fresh[at] = False
            moved = np.concatenate([at[some], prior])
            ranks = self.rank(sym[moved], sym[after[moved]])
            rank[moved] = ranks
            enlist(moved, ranks)
        return sym[alive], np.add.reduceat(alive, last - size + 1, dtype=np.int64)


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted places of a pair of twins, those to merge: in a chain of overlapping
    pairs every second one from its left end."""
    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
    first = np.maximum.accumulate(np.where(chained, 0, np.arange(at.size)))
    return at[(np.arange(at.size) - first) % 2 == 0]


class Codec:
    """Encodes and decodes texts as the library would, by :class:`PairIndex`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.index = PairIndex(path)
        self.rules = Tokenizer.from_file(path)  # its character rules only
        self.spaced = self.rules.normalizer is None
        self.classes = pretokens.CharClasses(self.rules, self.spaced)
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.index.added)) + ")") if self.index.added else None
        self.back = {c: b for b, c in enumerate(encoding.byte_letters())}
        tokens = [self.shown(self.index.tokens.get(i, "")) for i in range(self.index.width)]
        self.id_text = pa.array([b"%d " % i for i in range(self.index.width)], pa.binary())
        self.token_text = pa.array([t + self.index.gap for t in tokens], pa.binary())
        self.known: dict[bytes, tuple[int, bytes, bytes, bytes]] = {}
        self.bytes = 0

    def learn(self, words: list[bytes]) -> None:
        """Merge the new words; keep each one's count, ids, id text and token text."""
        if len(self.known) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.known, self.bytes = {}, 0
        new = [w for w in words if w not in self.known]
        self.bytes += sum(map(len, new))
        drop = [w for w in new if not self.spaced and self.classes.is_space(w)]
        self.known.update((w, (0, b"", b"", b"")) for w in drop)
        if drop:
            new = [w for w in new if w not in self.known]
        ids, counts = self.index.merge(new)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        flat = ids.astype("<i4").tobytes()
        raw = [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        self.known.update(zip(new, zip(counts.tolist(), raw, grouped(self.id_text, ids, bounds), grouped(self.token_text, ids, bounds), strict=True), strict=True))

    def chunk(self, texts: list[str]) -> Iterator[tuple[int, memoryview, memoryview, memoryview]]:
        """Of each text without added tokens: count, ids (int32 bytes), id text with a
        closing space, and token text with a closing gap."""
        plain = texts if self.spaced else [pretokens.normalize(t, self.rules) for t in texts]
        tokens, closing = pretokens.tokens_of(plain, self.classes)
        if not len(tokens):
            return
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        index = coded.indices.to_numpy().copy()
        index[closing] = len(words)
        count, raw, ids, shown = zip(*map(self.known.__getitem__, words), (0, b"", b"", b""), strict=True)
        upto = np.cumsum(np.array(count, np.int64)[index])
        ends = np.concatenate([[0], upto[closing]]).tolist()
        laid = [pa.array(x, pa.binary()).take(pa.array(index)) for x in (raw, ids, shown)]
        views = [(memoryview(x.buffers()[2] or b""), np.concatenate([[0], x_offsets(x)[closing + 1]]).tolist()) for x in laid]
        for i in range(closing.size):
            yield (ends[i + 1] - ends[i], *(v[o[i] : o[i + 1]] for v, o in views))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """As :meth:`chunk`, for texts that may hold added tokens: their strings are
        single tokens and the text between them is encoded piece by piece."""
        pieces, shape = [], []
        for t in texts:
            parts = self.split_added.split(t) if self.split_added and any(a in t for a in self.index.added) else [t]
            shape.append(parts)
            pieces.extend(p for k, p in enumerate(parts) if k % 2 == 0)
        done = self.chunk(pieces)
        for parts in shape:
            if len(parts) == 1:
                yield next(done)
                continue
            rows = []
            for k, p in enumerate(parts):
                if k % 2 == 0:
                    rows.append(next(done))
                else:
                    i = self.index.added[p]
                    rows.append((1, np.array([i], "<i4").tobytes(), b"%d " % i, self.shown(p) + self.index.gap))
            yield (sum(r[0] for r in rows), *(b"".join(bytes(r[k]) for r in rows) for k in (1, 2, 3)))

    def shown(self, token: str) -> bytes:
        """UTF-8 of a token as decoding writes it."""
        if self.index.byte_level and all(c in self.back for c in token):
            return bytes(self.back[c] for c in token)
        return token.encode()

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: tokens joined with spaces, or bytes where the file
        has the byte-level decoder; ids outside the vocabulary are skipped."""
        known = (self.index.tokens[i] for i in ids if i in self.index.tokens)
        return self.index.gap.join(map(self.shown, known)).decode("utf-8", "replace")


def x_offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def grouped(text: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The texts of ids, joined for each group of ids between bounds."""
    if not ids.size:
        return [b""] * (bounds.size - 1)
    laid = text.take(pa.array(ids))
    offsets = x_offsets(laid)[bounds].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), bounds.size - 1, [None, pa.py_buffer(offsets), laid.buffers()[2]]).to_numpy(zero_copy_only=False).tolist()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec, made once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array<int> column of each text's ids. Null texts give no ids; an
    ``ids`` column that is there already is replaced."""
    schema = T.StructType([f for f in df.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for batch in encoding.slices(batches, text, CHUNK_CHARS):
            made = list(codec(vocabulary).encode([t or "" for t in batch.column(text).to_pylist()]))
            offsets = np.concatenate([[0], np.cumsum([m[0] for m in made])]).astype(np.int32)
            flat = np.frombuffer(b"".join(bytes(m[1]) for m in made), "<i4")
            column = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            keep = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [column], keep + [ids])

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an array<int> column; null arrays give null."""
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            made = [None if x is None else codec(vocabulary).decode(x) for x in batch.column(ids).to_pylist()]
            keep = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(made, pa.string())], keep + [text])

    return df.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, vocabulary: str, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, sha256 of the decimal ids joined by spaces, sha256 of
    the decoded text. Null texts are empty (no ids, digests of nothing); every row is
    kept, repeated ones too; an empty table gives no rows; other columns are ignored."""

    def run(batches):
        for batch in encoding.slices(batches, "text", CHUNK_CHARS):
            gap = len(codec(vocabulary).index.gap)
            rows = [(n, hashlib.sha256(i[:-1]).hexdigest(), hashlib.sha256(d[: len(d) - gap]).hexdigest()) for n, _, i, d in codec(vocabulary).encode(batch.column("text").to_pylist())]
            n, i, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(by).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Encode and decode all documents."""
    return bpe_digests(common.documents(spark, sf_dir), common.tokenizer_path(vocabulary))
