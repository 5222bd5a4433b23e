"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of a bounded sample per language; the log-probability
matrix (buckets x languages) is broadcast and texts are scored in batches: the n-grams
of all texts of a batch form one sparse row list (bucket indices and row bounds), and a
text's scores are the sum of the matrix rows at its indices. One n-gram order is held at
a time, and long texts go through piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, encoding

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3, 4)
#: Labelled rows per language that training reads, about (a hash of the id decides).
SAMPLE_ROWS = 1_500
SMOOTHING = 0.5
#: Characters that are scored at once.
PORTION = 200_000
#: Odd multipliers of the n-gram hash, one per character place.
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
UNDETERMINED = "und"


class Letters:
    """Lower-case code of each letter, 32 for anything else; filled on demand."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.table[codes]
        if not found.all():
            for code in np.unique(codes[found == 0]).tolist():
                c = chr(code)
                self.table[code] = ord(c.lower()[0]) if c.isalpha() else 32
            found = self.table[codes]
        return found


_LETTERS: list[Letters] = []


def letters() -> Letters:
    """The worker's table, made once."""
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def portions(texts: list[str], most: int = PORTION) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first text, texts, folded codes, text of each code, codes carried over): texts that
    together have about ``most`` characters, or a piece of a longer one.

    Anything but letters counts as one space; every text gets a space at both ends. A
    piece begins with the last codes of the one before, for the n-grams across the cut.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > most:
            text, carried = texts[at], np.zeros(0, np.uint32)
            for a in range(0, len(text), most):
                piece = ("" if a else " ") + text[a : a + most] + (" " if a + most >= len(text) else "")
                low = letters().of(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32))
                low = np.concatenate([carried, low])
                keep = np.concatenate([[True], (low[1:] != 32) | (low[:-1] != 32)])
                low = low[keep]
                yield at, 1, low, np.zeros(low.size, np.int32), carried.size
                carried = low[-(max(ORDERS) - 1) :]
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= most:
            size += len(texts[to]) + 2
            to += 1
        to = max(to, at + 1)
        group = texts[at:to]
        codes = np.frombuffer("".join(f" {t} " for t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = letters().of(codes)
        text = np.repeat(np.arange(len(group), dtype=np.int32), [len(t) + 2 for t in group])
        keep = np.concatenate([[True], (low[1:] != 32) | (low[:-1] != 32) | (text[1:] != text[:-1])])
        yield at, len(group), low[keep], text[keep], 0
        at = to


def grams(low: np.ndarray, text: np.ndarray, carried: int = 0, bits: int = BITS) -> Iterator[np.ndarray]:
    """Per order, the bucket of the n-gram that begins at each code but the last ones;
    ``1 << bits``, where the matrix is 0, for those that cross texts or lie in what is
    carried over."""
    mixed = np.zeros(low.size, np.uint32)
    for order in ORDERS:
        n = low.size - order + 1
        if n <= 0:
            return
        mixed = mixed[:n] + low[order - 1 :] * MIX[order - 1]
        found = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found >>= np.uint32(32 - bits)
        found[text[:n] != text[order - 1 :]] = 1 << bits
        found[: max(0, carried - order + 1)] = 1 << bits
        yield found


class Model:
    """Languages and the log-probability matrix, its last row 0."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def score(self, texts: list[str], most: int = PORTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its probability, and whether there are letters."""
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.zeros(len(texts), np.int64)
        for first, n, low, text, carried in portions(texts, most):
            some[first : first + n] += np.bincount(text[carried:][low[carried:] != 32], minlength=n)
            bounds = np.searchsorted(text, np.arange(n))
            for found in grams(low, text, carried):
                use = bounds[bounds < found.size]
                for k, row in enumerate(self.matrix):
                    sums[first : first + use.size, k] += np.add.reduceat(row[found], use, dtype=np.float64)
        sums += self.prior
        best = sums.argmax(axis=1)
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        return best, 1 / share.sum(axis=1), some > 0


def train(docs: DataFrame, rows_per_language: int = SAMPLE_ROWS) -> Model:
    """Fit on rows with text and lang whose crc32(doc_id as text) mod 4 is not 2.

    ``docs`` has doc_id, text and lang. The sample per language is bounded (in
    expectation) by ``rows_per_language``; languages are those of the training rows.
    """
    fold = F.coalesce(common.crc32_of_id(), F.lit(0)) % 4
    fit = docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, rows_per_language / sizes[l]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / 1e6
    place = {l: k for k, l in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS + 1), np.int64)
        for batch in encoding.slices(batches, "text", PORTION):
            langs = np.array([place[l] for l in batch.column("lang").to_pylist()], np.int32)
            for first, _, low, text, carried in portions(batch.column("text").to_pylist()):
                own = langs[first + text]
                for found in grams(low, text, carried):
                    for k in np.unique(own).tolist():
                        total[k] += np.bincount(found[own[: found.size] == k], minlength=BUCKETS + 1)
        for k in range(len(languages)):
            (b,) = np.nonzero(total[k, :BUCKETS])
            for at in range(0, b.size, 10_000):
                part = b[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, k, np.int32)), pa.array(part.astype(np.int32)), pa.array(total[k, part])], ["l", "b", "n"])

    counts = fit.where(draw < share).select("text", "lang").mapInArrow(count, "l int, b int, n long")
    table = counts.groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    matrix = np.full((len(languages), BUCKETS), SMOOTHING)
    matrix[table["l"].to_numpy(), table["b"].to_numpy()] += table["n"].to_numpy()
    log = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    log = np.hstack([log, np.zeros((len(languages), 1))]).astype(np.float32)
    prior = np.log(np.array([sizes[l] for l in languages]) / sum(sizes.values()))
    return Model(languages, log, prior)


def identify(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score"), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with the predicted language and its probability.

    Null texts and texts without a letter get ``und`` and 0.0; so do all rows if there
    was nothing to learn from. Columns of the two names are replaced; other columns may
    have any names. Every row is kept; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(*into)
    names = [c for c in (keep or base.columns) if c not in into]
    fields = [f for n in names for f in base.schema.fields if f.name == n]

    source = f"c{names.index(text)}" if text in names else "__text"

    def run(batches):
        for batch in encoding.slices(batches, source, PORTION):
            m = shared.value
            if m.languages:
                best, share, some = m.score([t or "" for t in batch.column(source).to_pylist()])
                lang = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, share, 0.0)
            else:
                lang, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(f"c{k}" for k in range(len(names))), "__l", "__s"])

    # inside, columns go by number: names of the table can't clash with ours
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)), "__l string, __s double"])
    q = lambda n: F.col(f"`{n}`")
    sent = [q(n).alias(f"c{k}") for k, n in enumerate(names)] + ([] if text in names else [q(text).alias("__text")])
    done = base.select(*sent).mapInArrow(run, schema)
    return done.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], F.col("__l").alias(into[0]), F.col("__s").alias(into[1]))


def predictions(docs: DataFrame, rows_per_language: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; every row is kept, repeated ones too.
    A null doc_id is not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(rows, rows_per_language)
    held = F.coalesce(common.crc32_of_id() % 4 == 2, F.lit(False)).alias("held_out")
    return identify(rows.select("doc_id", held, "text"), model, keep=["doc_id", "held_out"])


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return predictions(common.documents(spark, sf_dir))
