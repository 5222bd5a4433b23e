"""Vocabulary, frequencies, keywords and corpus statistics.

Token tables are ``(doc_id, pos, token)``. All counts aggregate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import text as tx

# Stop words, punctuation tokens and boosted domain words of keyword ranking.
STOP_DE = (
    "der die das ein eine einen und oder aber ist sind war waren zu in im auf mit bei von vom zum zur "
    "fuer dass nicht auch so als wie wenn wir sie er es du ich mich dich sich man aus an am sein seine "
    "ihr ihre diese dieser dieses noch nur mehr ueber um"
).split()
STOP_EN = (
    "the a an and or but is are was were to of in on at with for from that this these those not as "
    "by be been being have has had do does did we you they he she it i me him her us them so if then "
    "than which who what how why"
).split()
STOP_MARKS = [".", "?", "!", ",", ":", ";", "'", "-"]
DOMAIN_WORDS = (
    "eigenvalue eigenvalues eigenvector eigenvectors kernel pagerank projection regularization convergence "
    "overfitting residual iteration fourier radiosity quantum neural matrix vector regression ridge stochastic "
    "polynomial diagonal subspace linear nonlinear feature emergence entropy probability bayes logic "
    "incompleteness mindfulness emotion perception euler music harmony consciousness intelligence artificial "
    "attention transformer embedding"
).split()
# The shorter list whose words weigh more in chunk vectors.
CHUNK_WORDS = (
    "eigenvalue eigenvalues eigenvector eigenvectors kernel pagerank projection regularization convergence "
    "overfitting residual iteration fourier radiosity quantum neural matrix vector regression ridge stochastic "
    "polynomial diagonal subspace linear nonlinear feature"
).split()
DOMAIN_BOOST, MIN_KEYWORD = 3.0, 3


def tokens(docs: DataFrame, by: str = "doc_id", text: str = "text", split=tx.plain_words) -> DataFrame:
    """(doc_id, pos, token) of every text; texts without tokens give no rows."""
    return docs.select(F.col(by).alias("doc_id"), F.posexplode(split(F.col(text))).alias("pos", "token"))


def token_counts(toks: DataFrame) -> DataFrame:
    """Term frequency per document, from a token table."""
    return toks.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def runs(words: Column) -> Column:
    """array of struct(token, n, first) of a list of words: each distinct one, how often it
    stands there and its first place. A sort inside the row, no shuffle."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("pos"))))

    def of(t: Column) -> Column:
        token = lambda i: F.get(t, i)["token"]
        places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        starts = F.filter(places, lambda i: (i == 0) | (token(i) != token(i - 1)))
        return F.transform(F.array(starts), lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(t))), lambda a, b: F.struct(token(a).alias("token"), (b - a).cast("long").alias("n"), F.get(t, a)["pos"].alias("first"))))[0]

    return F.filter(F.transform(F.array(placed), of)[0], lambda r: r["token"].isNotNull())


def row_counts(docs: DataFrame, by: str = "doc_id", text: str = "text", split=tx.plain_words) -> DataFrame:
    """(doc_id, token, n): term frequency of every row of ``docs``, counted inside the row.
    Rows with one id stay apart. Null and empty texts give no rows."""
    return docs.select(F.col(by).alias("doc_id"), F.explode(runs(split(F.col(text)))).alias("r")).select("doc_id", "r.token", "r.n")


def ranked_words(words: Column, k: int, stop: list[str] | None = None, domain: list[str] | None = None) -> Column:
    """array of struct(token, score): the k best keywords of a list of words, best first,
    as :func:`keywords` has them."""
    stop = STOP_DE + STOP_EN + STOP_MARKS if stop is None else stop
    boost = lambda w: F.when(w.isin(DOMAIN_WORDS if domain is None else domain), DOMAIN_BOOST).otherwise(0.0)
    content = F.filter(runs(words), lambda r: ~r["token"].isin(stop) & (F.length(r["token"]) >= MIN_KEYWORD))
    order = F.array_sort(F.transform(content, lambda r: F.struct((-(r["n"] + boost(r["token"]))).alias("down"), r["first"].alias("first"), r["token"].alias("token"))))
    return F.transform(F.slice(order, 1, k), lambda r: F.struct(r["token"].alias("token"), (-r["down"]).alias("score")))


def row_keywords(docs: DataFrame, k: int, by: str = "doc_id", text: str = "text", split=tx.plain_words) -> DataFrame:
    """(doc_id, rank, token, score) of every row of ``docs``, found inside the row."""
    best = docs.select(F.col(by).alias("doc_id"), F.posexplode(ranked_words(split(F.col(text)), k)).alias("i", "w"))
    return best.select("doc_id", (F.col("i") + 1).alias("rank"), "w.token", "w.score")


def row_chunks(docs: DataFrame, size: int = 100, by: str = "doc_id", text: str = "text", split=tx.plain_words) -> DataFrame:
    """(doc_id, chunk, tokens): consecutive pieces of ``size`` tokens of every row, the last
    shorter; cut inside the row."""
    rows = docs.select(F.col(by).alias("doc_id"), split(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size))).alias("chunk"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.slice("w", (F.col("chunk") * size + 1).cast("int"), size).alias("tokens"))


def vocabulary(toks: DataFrame, token: str = "token") -> DataFrame:
    """(token, token_id): distinct tokens in code point order, ids from 0.

    Ids come from range partitions and their sizes, so no task sorts all tokens.
    """
    from sparkloom.sources.dialog import numbered

    return numbered(toks.select(F.col(token).alias("token")).distinct(), "token", into="token_id")


def document_frequency(counts: DataFrame) -> DataFrame:
    """(token, df) from term frequencies (one row per document and token)."""
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def idf(frequency: DataFrame, documents: Column | int, vocab: DataFrame | None = None) -> DataFrame:
    """(token, df, idf): ln((P+1)/(df+1)) + 1 over its mean over the whole vocabulary,
    tokens of no document included."""
    rows = frequency if vocab is None else vocab.select("token").join(frequency, "token", "left")
    rows = rows.select("token", F.coalesce("df", F.lit(0)).alias("df"))
    n = documents if isinstance(documents, Column) else F.lit(documents)
    raw = rows.withColumn("raw", F.ln((n + 1) / (F.col("df") + 1)) + 1)
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("token", "df", F.try_divide("raw", "mean").alias("idf"))


def keywords(toks: DataFrame, k: int, stop: list[str] | None = None, domain: list[str] | None = None) -> DataFrame:
    """(doc_id, rank, token, score): most frequent content words, domain words boosted,
    ties by first place, then by token. Stop words, marks and words under three letters don't count."""
    stop = STOP_DE + STOP_EN + STOP_MARKS if stop is None else stop
    boost = F.when(F.col("token").isin(DOMAIN_WORDS if domain is None else domain), DOMAIN_BOOST).otherwise(0.0)
    content = toks.where(~F.col("token").isin(stop) & (F.length("token") >= MIN_KEYWORD))
    scored = content.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("score", F.col("n") + boost)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "first", "token"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "token", "score")


def top_tokens(toks: DataFrame, n: int = 1000) -> DataFrame:
    """The n most frequent tokens, ties by token."""
    return toks.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def corpus_stats(toks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents, tokens, distinct tokens."""
    distinct = toks.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"))
    return documents.agg(F.count("*").alias("documents")).join(F.broadcast(distinct))


def fixed_chunks(toks: DataFrame, size: int = 100) -> DataFrame:
    """(doc_id, chunk, tokens): consecutive pieces of ``size`` tokens, the last shorter."""
    at = F.floor(F.col("pos") / size).alias("chunk")
    rows = toks.groupBy("doc_id", at).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))  # at most size rows a group
    return rows.select("doc_id", "chunk", F.transform("x", lambda t: t["token"]).alias("tokens"))
