"""Vectorised pre-tokenization of whole batches of texts.

Texts are joined with one separator byte each, byte classes come from a table, and token
starts from comparisons between neighbouring classes, so no per-token Python runs. Which
code points are letters, numbers or white space is asked of the tokenizer itself, so the
classes are exactly those of the library that reads the vocabulary.

Two splitting rules are covered, those of the two JSON vocabularies:

* ``spaced``: contractions, runs of letters / numbers / others with one leading space,
  white space runs that leave their last character to what follows;
* ``words``: contractions, runs of letters, single numbers, runs of others; white space
  is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
UNKNOWN = 255


class CharClasses:
    """Class of every code point, filled on demand by probing a pre-tokenizer."""

    def __init__(self, tokenizer, spaced: bool):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.spaced = spaced
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.learn(np.arange(0x250))
        self.bytes = self.table[:128].copy()
        self.bytes.resize(256)

    def learn(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            if 0xD800 <= code <= 0xDFFF:
                continue
            self.table[code] = self.probe(chr(code))

    def probe(self, c: str) -> int:
        if not self.spaced:  # numbers stand alone, white space vanishes
            if not self.split(c):
                return SPACE
            if len(self.split("a" + c)) == 1:
                return LETTER
            return NUMBER if len(self.split(c + c)) == 2 else OTHER
        if len(self.split("a" + c)) == 1:
            return LETTER
        if len(self.split("1" + c)) == 1:
            return NUMBER
        return OTHER if len(self.split("+" + c)) == 1 else SPACE

    def is_space(self, token: bytes) -> bool:
        """Of a pre-token: does it consist of white space?"""
        return self.table[ord(token.decode()[0])] == SPACE

    def of(self, data: np.ndarray) -> np.ndarray:
        """Class of each byte; bytes that continue a character repeat its class."""
        cls = self.bytes[data]
        lead = np.flatnonzero(data >= 0xC0)
        if lead.size:
            b0 = data[lead].astype(np.int64)
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            b1, b2, b3 = (padded[lead + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
            size = np.where(b0 >= 0xF0, 4, np.where(b0 >= 0xE0, 3, 2))
            code = np.where(
                size == 2,
                (b0 & 0x1F) << 6 | b1,
                np.where(size == 3, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3),
            )
            found = self.table[code]
            if (found == UNKNOWN).any():
                self.learn(np.unique(code[found == UNKNOWN]))
                found = self.table[code]
            cls[lead] = found
            for k in (1, 2, 3):
                more = size > k
                cls[lead[more] + k] = found[more]
        return cls


def join_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one separator; the separators' places."""
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
    return data, ends


def contractions(data: np.ndarray, quote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of token-starting quotes: those that begin 's 't 'm 'd 're 've 'll, and the sizes."""
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b = padded[quote + 1], padded[quote + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    hit = one | two
    return quote[hit], np.where(one[hit], 2, 3)


def token_starts(data: np.ndarray, ends: np.ndarray, classes: CharClasses) -> np.ndarray:
    """True at each byte where a token begins; separators are tokens of their own."""
    n = data.size
    cls = classes.of(data)
    cls[ends] = END
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start[ends] = True
    follow = ends[:-1] + 1
    start[follow] = True
    lead = (data & 0xC0) != 0x80
    if classes.spaced:
        run_end = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & (cls[1:] != END)) + 1
        last = run_end - 1
        for _ in range(3):  # back to the first byte of the last white space character
            last = np.where(lead[last], last, last - 1)
        start[last] = True
        start[run_end[data[last] == 0x20]] = False
    else:
        start |= (cls == NUMBER) & lead
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[quote + 1 < n]
    if quote.size:
        at, size = contractions(data, quote)
        start[at + 1] = False
        after = at + size
        start[after[after < n]] = True
    return start


def tokens_of(texts: list[str], classes: CharClasses) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the texts as one Arrow binary array, and the index of each text's
    separator token."""
    if not texts:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    data, ends = join_texts(texts)
    places = np.flatnonzero(token_starts(data, ends, classes))
    offsets = np.append(places, data.size).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), places.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return tokens, np.searchsorted(places, ends)


def normalize(text: str, tokenizer) -> str:
    """The tokenizer's normal form (composed, lower case). White space is left as it is:
    the rule ``words`` drops all of it anyway. Texts within Latin-1 are composed already
    and ``str.lower`` agrees with the library there; others go through the library."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return tokenizer.normalizer.normalize_str(text)
    return text.lower()
