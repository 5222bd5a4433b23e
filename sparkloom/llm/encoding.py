"""Library tokenization of batches with one library call per new token.

Pre-tokens repeat, so each worker keeps the ids of those it has met; the tokenizers
library encodes the others, and numpy lays the ids out in text order.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from sparkloom.llm import pretokens

#: Pre-tokens whose ids a worker keeps, and their bytes; past either the cache starts anew.
CACHE_TOKENS, CACHE_BYTES = 400_000, 16_000_000
#: Characters of text handled at once.
CHUNK_CHARS = 2_500_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class BatchEncoder:
    """``Tokenizer.encode`` of many texts at once, with one closing id after each text.

    The library's model gets each new pre-token once, in byte letters; pre-tokens are
    split by :mod:`pretokens`. Texts that hold a special token's own string go through
    the library whole.
    """

    def __init__(self, path: str, closing_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = self.tokenizer.normalizer is None
        self.classes = pretokens.CharClasses(self.tokenizer, self.spaced)
        self.closing = [] if closing_id is None else [closing_id]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {b"": 0}  # place 0: a text's end
        self.start = np.zeros(1024, np.int32)
        self.count = np.zeros(1024, np.int32)
        self.count[0] = len(self.closing)
        self.pool = np.zeros(4096, np.uint32)
        self.pool[: len(self.closing)] = self.closing
        self.used = len(self.closing)
        self.bytes = 0

    def library_ids(self, words: list[bytes]) -> list[list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        drop = not self.spaced
        return [
            [] if drop and self.classes.is_space(w) else [t.id for t in tokenize(w.decode("latin-1").translate(letters))]
            for w in words
        ]

    def places_of(self, words: list[bytes]) -> np.ndarray:
        """Cache places of pre-tokens, after encoding the new ones."""
        if len(self.place) > CACHE_TOKENS or self.bytes > CACHE_BYTES:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            ids = self.library_ids(new)
            base, sizes = len(self.place), np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
            to, end = base + len(new), self.used + flat.size
            self.start, self.count = grown(self.start, to), grown(self.count, to)
            self.pool = grown(self.pool, end)
            self.start[base:to] = self.used + np.cumsum(sizes) - sizes
            self.count[base:to] = sizes
            self.pool[self.used : end] = flat
            self.used = end
            self.place.update(zip(new, range(base, to), strict=True))
            self.bytes += sum(map(len, new))
        return np.fromiter(map(self.place.__getitem__, words), np.int32, len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) in text order and the bounds of each text: n + 1 offsets."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)] if odd else texts
        if not self.spaced:
            plain = [pretokens.normalize(t, self.tokenizer) for t in plain]
        tokens, closing = pretokens.tokens_of(plain, self.classes)
        if not len(tokens):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        coded = tokens.dictionary_encode()
        places = np.append(self.places_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int32(0))
        index = coded.indices.to_numpy().copy()
        index[closing] = places.size - 1
        # the chunk's own dictionary of id lists, laid out in text order by Arrow
        count, start = self.count[places], self.start[places]
        upto = np.cumsum(count, dtype=np.int32)
        source = np.repeat(start - (upto - count), count) + np.arange(upto[-1], dtype=np.int32)
        lists = pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), upto]), pa.array(self.pool[source]))
        laid = lists.take(pa.array(index))
        ends = laid.offsets.to_numpy()
        ids, bounds = laid.flatten().to_numpy(), np.concatenate([[0], ends[closing + 1].astype(np.int64)])
        return self.with_odd(texts, ids, bounds, odd) if odd else (ids, bounds)

    def with_odd(self, texts: list[str], ids: np.ndarray, bounds: np.ndarray, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids + self.closing, np.uint32) for i in odd}
        parts = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` entries at least."""
    if size <= array.size:
        return array
    more = np.zeros(size + size // 2, array.dtype)
    more[: array.size] = array
    return more


_ENCODERS: dict[tuple, BatchEncoder] = {}


def encoder(path: str, closing_id: int | None) -> BatchEncoder:
    """The worker's encoder, made once."""
    key = (path, closing_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = BatchEncoder(path, closing_id)
    return _ENCODERS[key]


def slices(batches: Iterable[pa.RecordBatch], column: str, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut (zero-copy) so that each holds about ``chars`` bytes of ``column`` at
    most; a longer single text makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        sizes = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts
        offsets = np.frombuffer(sizes.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + chars, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
