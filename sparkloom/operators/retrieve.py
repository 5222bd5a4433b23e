"""Retrieval: inverted-index keyword scores, bag-of-words cosine, combined score.

The keyword score's normalization and the fallback threshold are definitions of this
library: kw_raw = sum of idf over the distinct tokens that query and entry share;
s_kw = kw_raw / sum of idf over the query's distinct known tokens (0 if none);
score = 0.65 s_kw + 0.35 max(cosine, 0); ties go to the smaller entry id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.sources import tables

# The combined score's weights.
KEYWORD_SHARE, MEANING_SHARE = 0.65, 0.35
#: Size up to which a table of vectors is sent to every task.
VECTORS_BYTES = 64_000_000


def weighted(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, token, idf, w): w = n * idf. Tokens without a weight are left out."""
    return counts.join(weights.select("token", "idf"), "token").select("doc_id", "token", "idf", (F.col("n") * F.col("idf")).alias("w"))


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, token, n, idf, w, unit): w = n * idf; unit = w / (|w| + 1e-10). Tokens
    without a weight are left out."""
    rows = counts.join(weights.select("token", "idf"), "token").withColumn("w", F.col("n") * F.col("idf"))
    norm = rows.groupBy("doc_id").agg((F.sqrt(F.sum(F.col("w") * F.col("w"))) + 1e-10).alias("norm"))
    return rows.join(norm, "doc_id").select("doc_id", "token", "n", "idf", "w", (F.col("w") / F.col("norm")).alias("unit"))


def score(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, entry_id, kw_raw, s_kw, cosine, score) of all pairs that share a token.

    ``queries`` is a tf-idf table with query_id for doc_id, ``entries`` a weighted one
    (:func:`weighted`) with entry_id. The join is on the token, so pairs without a common
    token are never made; entries' norms meet the pairs, not their tokens.
    """
    known = queries.groupBy("query_id").agg(F.sum("idf").alias("possible"))
    q = queries.select("query_id", "token", "idf", F.col("unit").alias("qu"))
    e = entries.select("entry_id", "token", F.col("w").alias("ew"))
    norm = entries.groupBy("entry_id").agg((F.sqrt(F.sum(F.col("w") * F.col("w"))) + 1e-10).alias("norm"))
    # an entry's rows lie together, so a task's sums are whole before the shuffle
    met = q.join(e, "token").groupBy("query_id", "entry_id").agg(F.sum("idf").alias("kw_raw"), F.sum(F.col("qu") * F.col("ew")).alias("cosine"))
    met = met.join(norm, "entry_id").withColumn("cosine", F.col("cosine") / F.col("norm"))
    met = met.join(known, "query_id").withColumn("s_kw", F.when(F.col("possible") > 0, F.col("kw_raw") / F.col("possible")).otherwise(0.0))
    total = KEYWORD_SHARE * F.col("s_kw") + MEANING_SHARE * F.greatest("cosine", F.lit(0.0))
    return met.select("query_id", "entry_id", "kw_raw", "s_kw", "cosine", total.alias("score"))


# ---- the best entries, by upper bounds

#: Tokens of the queries that one pass over the entries takes along; more queries take more
#: passes.
PASS_TOKENS = 1_000_000
#: Cells (entries times queries), and meetings of an entry's token with a query's, that are
#: scored at once.
BLOCK_CELLS = 1_000_000
#: Scores are compared at 9 digits: what may still round up to a bound isn't left out.
MARGIN = 2e-9
FOUND = "kw_raw double, s_kw double, cosine double, score double"


def index(entries: DataFrame) -> DataFrame:
    """(entry_id, tokens, impacts) of a weighted table, a row an entry: impacts are weights
    over the entry's norm."""
    rows = entries.groupBy("entry_id").agg(F.collect_list(F.struct("token", "w")).alias("e"))  # an entry's distinct tokens
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])) + 1e-10
    return rows.withColumn("norm", norm).select("entry_id", F.col("e.token").alias("tokens"), F.transform("e", lambda x: x["w"] / F.col("norm")).alias("impacts"))


class Asked:
    """A block of queries by token, and what a query's most frequent tokens add at most.

    A token adds its keyword share, and its unit weight times its impact. The impacts of an
    entry are a unit vector, so tokens together add their keyword shares and the norm of their
    unit weights at most. ``upto`` is that bound of a token and all more frequent ones of its
    query: those whose bound falls short of the score to reach are set aside.
    """

    def __init__(self, rows: pa.Table):
        ids = rows["query_id"].combine_chunks().dictionary_encode()
        self.ids, query = ids.dictionary, ids.indices.to_numpy()
        tokens = rows["token"].combine_chunks().dictionary_encode()
        self.words, word = tokens.dictionary, tokens.indices.to_numpy()
        idf, unit = rows["idf"].to_numpy(), rows["unit"].to_numpy()
        self.size, self.possible = len(self.ids), np.bincount(query, idf, minlength=len(self.ids))
        order = np.lexsort((word, idf, query))  # frequent tokens have a small idf
        query, word, idf, unit = (x[order] for x in (query, word, idf, unit))
        keyword = np.divide(KEYWORD_SHARE * idf, self.possible[query], out=np.zeros_like(idf), where=self.possible[query] > 0)
        first = np.searchsorted(query, query)
        sums = [np.cumsum(x) for x in (keyword, unit * unit)]
        sums = [c - (c[first] - x[first]) for c, x in zip(sums, (keyword, unit * unit), strict=True)]
        upto = sums[0] + MEANING_SHARE * np.sqrt(np.maximum(sums[1], 0))
        self.asking = np.bincount(word, minlength=len(self.words))  # queries of each word
        self.first = np.searchsorted(query, np.arange(self.size + 1))  # by query, frequent tokens first
        self.query_word, self.query_idf, self.query_unit, self.query_upto = word, idf, unit, upto
        turn = np.argsort(word, kind="stable")
        self.query, self.word, self.idf, self.unit, self.keyword, self.upto = (x[turn] for x in (query, word, idf, unit, keyword, upto))

    def essential(self, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens not set aside, by word: which, where each word's begin, and for each query
        the number of tokens set aside and what they add at most."""
        use = np.flatnonzero(self.upto >= goal[self.query] - MARGIN)
        start = np.searchsorted(self.word[use], np.arange(len(self.words) + 1))
        aside = self.query_upto < np.repeat(goal - MARGIN, np.diff(self.first))
        count = np.add.reduceat(aside, self.first[:-1]) if self.size else np.zeros(0, np.int64)
        last = self.first[:-1] + np.maximum(count, 1) - 1
        return use, start, count, np.where(count > 0, self.query_upto[last], 0.0)


class Finder:
    """The ``k`` best entries of each query among those seen so far. ``scored`` counts the
    pairs whose score was made up, ``met`` those with a token that isn't set aside."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k, self.met, self.scored = asked, k, 0, 0
        self.goal = np.full(asked.size, -np.inf)
        self.best: list[tuple] = [()] * asked.size

    def see(self, entry_ids: list, entry: np.ndarray, word: np.ndarray, impact: np.ndarray) -> None:
        """Entries and their tokens among the queries': entry's place (ascending), word, impact.
        Blocks of whole entries are scored at once, of ``BLOCK_CELLS`` meetings or a single entry."""
        a = self.asked
        first = np.searchsorted(entry, np.arange(len(entry_ids) + 1))
        meetings = np.concatenate([[0], np.cumsum(a.asking[word])])[first]
        at, each = 0, max(BLOCK_CELLS // max(a.size, 1), 1)
        while at < len(entry_ids):
            upto = int(np.searchsorted(meetings, meetings[at] + BLOCK_CELLS, "right")) - 1
            end = min(max(upto, at + 1), at + each, len(entry_ids))
            rows = slice(first[at], first[end])
            self._see_block(entry_ids[at:end], entry[rows] - at, word[rows], impact[rows])
            at = end

    def _see_block(self, entry_ids: list, entry: np.ndarray, word: np.ndarray, impact: np.ndarray) -> None:
        a, n = self.asked, self.asked.size
        use, start, count, rest = a.essential(self.goal)
        times = start[word + 1] - start[word]
        hit = np.repeat(np.arange(word.size), times)
        row = use[np.arange(hit.size) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[word], times)]
        part = np.bincount(entry[hit] * n + a.query[row], a.keyword[row] + MEANING_SHARE * a.unit[row] * impact[hit], minlength=len(entry_ids) * n)
        pairs = np.flatnonzero(part > 0)
        self.met += pairs.size
        e, q = np.divmod(pairs, n)
        likely = part[pairs] + rest[q] >= self.goal[q] - MARGIN
        e, q = e[likely], q[likely]
        self.scored += e.size
        if not e.size:
            return
        key = entry * len(a.words) + word
        order = np.argsort(key)
        key, of = key[order], impact[order]
        turn = np.unique(np.array(entry_ids), return_inverse=True)[1]
        # whole scores of what is left, in pieces: a pair takes all of its query's tokens
        ends = np.cumsum(a.first[q + 1] - a.first[q])
        lo = 0
        while lo < e.size:
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_CELLS, "right")), lo + 1)
            self._score(entry_ids, turn, e[lo:hi], q[lo:hi], key, of)
            lo = hi

    def _score(self, entry_ids: list, turn: np.ndarray, e: np.ndarray, q: np.ndarray, key: np.ndarray, of: np.ndarray) -> None:
        """Pairs of entries and queries: the query's tokens are looked up among the entry's."""
        a = self.asked
        size = a.first[q + 1] - a.first[q]
        pair = np.repeat(np.arange(e.size), size)
        at = np.arange(pair.size) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a.first[q], size)
        wanted = e[pair] * len(a.words) + a.query_word[at]
        place = np.minimum(np.searchsorted(key, wanted), key.size - 1)
        has = key[place] == wanted
        kw = np.bincount(pair[has], a.query_idf[at[has]], minlength=e.size)
        cos = np.bincount(pair[has], a.query_unit[at[has]] * of[place[has]], minlength=e.size)
        share = np.divide(kw, a.possible[q], out=np.zeros_like(kw), where=a.possible[q] > 0)
        score = KEYWORD_SHARE * share + MEANING_SHARE * np.maximum(cos, 0)
        # rows are made of a query's k best only
        order = np.lexsort((turn[e], -np.round(score, 9), q))
        ordered = q[order]
        order = order[np.arange(order.size) - np.searchsorted(ordered, ordered) < self.k]
        for i in order[score[order] >= self.goal[q[order]] - MARGIN].tolist():
            self.best[q[i]] += ((-round(score[i], 9), entry_ids[e[i]], kw[i], share[i], cos[i], score[i]),)
        for j in np.unique(q).tolist():
            if len(self.best[j]) > self.k:
                self.best[j] = tuple(sorted(self.best[j], key=lambda x: x[:2])[: self.k])
            if len(self.best[j]) == self.k:
                self.goal[j] = self.best[j][-1][5]

    def see_batch(self, batch: pa.RecordBatch) -> None:
        """Rows of :func:`index`."""
        tokens, a = batch.column("tokens"), self.asked
        entry = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy(zero_copy_only=False))
        word = pc.index_in(tokens.flatten(), value_set=a.words)
        known = word.is_valid().to_numpy(zero_copy_only=False)
        impact = batch.column("impacts").flatten().to_numpy(zero_copy_only=False)
        self.see(batch.column("entry_id").to_pylist(), entry[known], word.drop_null().to_numpy().astype(np.int64), impact[known])

    def see_rows(self, batches) -> None:
        """Batches of (entry_id, word, impact), an entry's rows together; the last entry of a
        batch waits for its other rows."""
        kept = []
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("entry_id")
                new = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1
                last = int(new[-1]) if new.size else 0
                if last or kept and kept[-1].column("entry_id")[-1] != ids[0]:
                    self._see_whole([*kept, batch.slice(0, last)])
                    kept = []
                kept.append(batch.slice(last))
        if kept:
            self._see_whole(kept)

    def _see_whole(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids = rows["entry_id"].combine_chunks()
        new = np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)])
        self.see(ids.filter(pa.array(new)).to_pylist(), np.cumsum(new) - 1, rows["word"].to_numpy().astype(np.int64), rows["impact"].to_numpy())


def search(queries: DataFrame, entries: DataFrame, k: int = 1, pass_tokens: int = PASS_TOKENS) -> DataFrame:
    """The rows of ``best(score(queries, entries), k)``, without their pairs: the entries
    stream past a stated set of queries, in passes of ``pass_tokens`` of their tokens.

    Only tokens that a query has are dealt by entries, a row a token with its impact (its
    weight over the entry's norm), so no row and no batch grows with an entry. A task holds the
    k best entries of each query so far. Tokens of a query that can't reach the k-th score
    together are set aside; a pair that shares nothing else isn't looked at, and one whose other
    tokens and the most that those may add fall short isn't scored. Tasks hand on k rows a
    query. Weights aren't negative; queries without a token that an entry has get no rows.
    """
    spark = queries.sparkSession
    asked = tables.cut(queries.select("query_id", "token", "idf", "unit"), "asked")
    total = asked.count()
    passes = max(1, -(-total // pass_tokens))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
    norms = entries.groupBy("entry_id").agg((F.sqrt(F.sum(F.col("w") * F.col("w"))) + 1e-10).alias("norm"))
    if passes > 1:
        norms = tables.cut(norms, "norms")
    kinds = {c: dict(queries.dtypes + entries.dtypes)[c] for c in ("query_id", "entry_id")}
    schema = f"query_id {kinds['query_id']}, entry_id {kinds['entry_id']}, {FOUND}"
    entry_type = entries.select("entry_id").limit(0).toArrow().schema.field(0).type
    found = None
    for p in range(passes):
        rows = asked.where(F.col("pass") == p).drop("pass").toArrow()
        words = Asked(rows).words
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            finder = Finder(Asked(shared.value), k)
            finder.see_rows(batches)
            rows = [(j, *r[1:]) for j, best_of in enumerate(finder.best) for r in best_of]
            if rows:
                columns = list(zip(*rows, strict=True))
                ids = [finder.asked.ids.take(pa.array(columns[0])), pa.array(columns[1], entry_type)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.float64()) for c in columns[2:])], ["query_id", "entry_id", "kw_raw", "s_kw", "cosine", "score"])

        known = spark.createDataFrame(pa.table({"token": words.cast(pa.string()), "word": pa.array(np.arange(len(words), dtype=np.int32))}), "token string, word int")
        dealt = entries.join(known, "token").select("entry_id", "word", "w").join(norms, "entry_id").select("entry_id", "word", (F.col("w") / F.col("norm")).alias("impact"))
        part = dealt.repartition("entry_id").sortWithinPartitions("entry_id").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return best(found, k)


def best(scored: DataFrame, k: int = 1, digits: int = 9) -> DataFrame:
    """The k best entries of each query, rank from 1. Scores are compared at ``digits``
    places, so that summation order can't decide."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "entry_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_fallback(queries: DataFrame, answers: DataFrame, threshold: float) -> DataFrame:
    """(query_id, entry_id, kw_raw, is_fallback): the best entry of each query, or none
    if its kw_raw is under the threshold or nothing was found."""
    rows = queries.select("query_id").distinct().join(answers.where("rank = 1"), "query_id", "left")
    weak = F.coalesce(F.col("kw_raw") < threshold, F.lit(True))
    return rows.select("query_id", F.when(~weak, F.col("entry_id")).alias("entry_id"), F.coalesce("kw_raw", F.lit(0.0)).alias("kw_raw"), weak.alias("is_fallback"))


def greet(queries: DataFrame, greetings: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, entry_id, kw_raw, is_fallback): a query whose whole text, in lower case and
    without blanks and stops at its ends, is a greeting takes that greeting's answer at once,
    with the score 99; the others keep theirs. ``greetings``: (text, entry_id), few rows; of
    equal texts the smallest entry counts."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s.!?]+|[\s.!?]+$", ""))
    known = greetings.groupBy(plain(F.col("text")).alias("said")).agg(F.min("entry_id").alias("greeting"))
    rows = answers.join(queries.select("query_id", plain(F.col("text")).alias("said")), "query_id").join(known, "said", "left")
    hit = F.col("greeting").isNotNull()
    return rows.select("query_id", F.when(hit, F.col("greeting")).otherwise(F.col("entry_id")).alias("entry_id"), F.when(hit, F.lit(99.0)).otherwise(F.col("kw_raw")).alias("kw_raw"), (~hit & F.col("is_fallback")).alias("is_fallback"))


def summed_vectors(weights: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, vec) from (doc_id, place, w): the sum of w * vectors[place] over a document's
    rows, over its norm + 1e-10. ``vectors`` is a table of a checked size; a task adds up
    what it has of a document before anything is shuffled. Null places are left out."""
    if vectors.nbytes > VECTORS_BYTES:
        raise ValueError("too many vectors to send to every task: join them instead (stored_vectors)")
    shared, dims = weights.sparkSession.sparkContext.broadcast(vectors), vectors.shape[1]

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                doc, place, w = batch.column("doc_id"), batch.column("place").to_numpy(), batch.column("w").to_numpy()
                new = pc.fill_null(pc.not_equal(doc[1:], doc[:-1]), True).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate([[True], new]))
                total = np.add.reduceat(shared.value[place] * w[:, None], starts, axis=0)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(starts)), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(dims))], ["doc_id", *(f"d{k}" for k in range(dims))])

    rows = weights.where(F.col("place").isNotNull()).select("doc_id", F.col("place").cast("int").alias("place"), F.col("w").cast("double").alias("w"))
    # a document's places come together first: a place and a weight are shuffled, not a vector
    # for each task that has some of them
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    parts = rows.mapInArrow(add, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"d{k} double" for k in range(dims)))
    return _unit(parts, dims)


def stored_vectors(weights: DataFrame, table: DataFrame, dims: int, block: int = 32_768) -> DataFrame:
    """As :func:`summed_vectors`, with the vectors as a table (place, emb) of any size, which is
    written in blocks to the shared folder. A task goes through its documents block by block and
    holds one; what is shuffled are a place and a weight, and then a vector a document."""
    spark, folder = weights.sparkSession, tables.fresh_path(weights.sparkSession, "blocks")
    own = table.select(F.floor(F.col("place") / block).cast("int").alias("block"), F.pmod("place", F.lit(block)).cast("int").alias("at"), F.col("emb").cast("array<double>").alias("emb"))
    own.repartition("block").write.option("parquet.block.size", 8 << 20).partitionBy("block").parquet(folder)

    def read(number: int) -> np.ndarray:
        out = np.zeros((block, dims))
        fs, path = pafs.FileSystem.from_uri(f"{folder}/block={number}")
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return out
        for file in (f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".parquet")):
            with fs.open_input_file(file) as opened:
                for batch in pq.ParquetFile(opened).iter_batches(4_096, columns=["at", "emb"]):
                    out[batch.column("at").to_numpy()] = batch.column("emb").flatten().to_numpy().reshape(-1, dims)
        return out

    def add(batches):
        key, held = None, None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cut = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)], strict=True):
                if lo == hi:
                    continue
                if key != blocks[lo]:
                    key, held = blocks[lo], read(int(blocks[lo]))
                part = batch.slice(lo, hi - lo)
                doc, at, w = part.column("doc_id"), part.column("at").to_numpy(), part.column("w").to_numpy()
                new = pc.fill_null(pc.not_equal(doc[1:], doc[:-1]), True).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate([[True], new]))
                total = np.add.reduceat(held[at] * w[:, None], starts, axis=0)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(starts)), *(pa.array(np.ascontiguousarray(total[:, k])) for k in range(dims))], ["doc_id", *(f"d{k}" for k in range(dims))])

    rows = weights.where(F.col("place").isNotNull()).select("doc_id", F.floor(F.col("place") / block).cast("int").alias("block"), F.pmod("place", F.lit(block)).cast("int").alias("at"), F.col("w").cast("double").alias("w"))
    rows = rows.repartition("doc_id").sortWithinPartitions("block", "doc_id")
    parts = rows.mapInArrow(add, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"d{k} double" for k in range(dims)))
    return _unit(parts, dims)


def _unit(parts: DataFrame, dims: int) -> DataFrame:
    """(doc_id, vec): sums of a document's parts (doc_id, d0, d1, ...) over their norm + 1e-10."""
    sums = parts.groupBy("doc_id").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(dims)]).select("doc_id", F.array(*[f"d{k}" for k in range(dims)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + 1e-10
    return sums.withColumn("norm", norm).select("doc_id", F.transform("v", lambda x: x / F.col("norm")).alias("vec"))


def chunk_counts(chunks: DataFrame, key: str = "url") -> DataFrame:
    """(doc_id, token, n) of chunks: words of the text and the keywords, repeats kept."""
    all_words = F.concat(F.filter(F.split("text", " "), lambda t: t != ""), F.coalesce("keywords", F.expr("cast(array() as array<string>)")))
    return chunks.select(F.col(key).alias("doc_id"), F.explode(all_words).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def domain_boost(words: list[str], factor: float = 3.0) -> F.Column:
    """Weight of domain words, whatever their case; 1 for others."""
    return F.when(F.lower("token").isin(words), factor).otherwise(1.0)
