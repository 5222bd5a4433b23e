"""Evaluation: response parsing, assertions, roll-ups, accuracy, errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.sources import tables

# What the status lines look like.
MATCH, KW, KW_MAX = r'match:\s*"([^"]*)"', r"kwRaw=([0-9.]+)", r"kwMax=([0-9.]+)"
TOP3, WORDS, GREETING = r"(\d+)%\s*Top-3", r"(\d+)w\s*·", r'greeting:\s*"([^"]*)"'
GREETING_SCORE = 99.0
THRESHOLD = 0.8


def parse_response(line: Column) -> list[Column]:
    """matched_pair, kw_raw, top3_pct, word_count, is_fallback of a status line."""
    has = lambda p: line.rlike(p)
    get = lambda p: F.regexp_extract(line, p, 1)
    number = lambda p, kind="double": F.coalesce(get(p).try_cast(kind), F.lit(0).cast(kind))  # noqa: E731  1.2.3 is no number
    fallback = F.lower(line).contains("fallback")
    matched = F.when(has(GREETING), get(GREETING)).when(has(MATCH), get(MATCH)).otherwise("")
    kw = F.when(has(GREETING), GREETING_SCORE).when(fallback & has(KW_MAX), number(KW_MAX)).when(has(KW), number(KW)).otherwise(0.0)
    top3 = F.when(has(TOP3), number(TOP3)).otherwise(0.0)
    count = F.when(has(WORDS), number(WORDS, "int")).otherwise(0)
    return [matched.alias("matched_pair"), kw.alias("kw_raw"), top3.alias("top3_pct"), count.alias("word_count"), F.coalesce(fallback, F.lit(False)).alias("is_fallback")]


def parse_bubble(text: Column) -> list[Column]:
    """response and the fields of :func:`parse_response` of an answer of several lines.

    The first line is the response. Every line may hold fields, the last line with a field
    decides; within a line a greeting outdoes a fallback's number, and that one the match's.
    Null texts have an empty response and no fields.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), "\n")
    last = lambda found: F.element_at(F.concat(F.array(F.lit(None)), F.filter(found, lambda x: x.isNotNull())), -1)
    of = lambda pattern: lambda l: F.when(l.rlike(pattern), F.regexp_extract(l, pattern, 1))
    named = lambda l: F.coalesce(of(GREETING)(l), of(MATCH)(l))

    def score(l: Column) -> Column:
        weak = F.when(F.lower(l).contains("fallback"), of(KW_MAX)(l).try_cast("double"))
        return F.coalesce(F.when(l.rlike(GREETING), GREETING_SCORE), weak, of(KW)(l).try_cast("double"))

    number = lambda pattern, kind: F.coalesce(last(F.transform(lines, lambda l: of(pattern)(l).try_cast(kind))), F.lit(0).cast(kind))
    return [
        lines[0].alias("response"),
        F.coalesce(last(F.transform(lines, named)), F.lit("")).alias("matched_pair"),
        F.coalesce(last(F.transform(lines, score)), F.lit(0.0)).alias("kw_raw"),
        number(TOP3, "double").alias("top3_pct"),
        number(WORDS, "int").alias("word_count"),
        F.exists(lines, lambda l: F.lower(l).contains("fallback")).alias("is_fallback"),
    ]


def check_states(rows: DataFrame) -> DataFrame:
    """As :func:`check`, with the state before a turn first: where ``state_contains`` isn't
    part of the lower-case ``last_bot``, the turn isn't played. Its response says so, its
    fields are empty and it fails."""
    missing = F.col("state_contains").isNotNull() & ~F.contains(F.lower(F.coalesce("last_bot", F.lit(""))), F.col("state_contains"))
    checked = check(rows.withColumn("state_missing", missing))
    # What stands for an answer that wasn't asked for.
    unplayed = {"response": F.concat(F.lit('[STATE CHECK] lastBotTurn missing "'), "state_contains", F.lit('"')), "matched_pair": F.lit(""), "kw_raw": F.lit(0.0), "top3_pct": F.lit(0.0), "word_count": F.lit(0), "is_fallback": F.lit(False), "fail_reason": F.lit("state"), "passed": F.lit(False)}
    return checked.withColumns({c: F.when(F.col("state_missing"), v).otherwise(F.col(c)) for c, v in unplayed.items() if c in checked.columns})


def check(rows: DataFrame) -> DataFrame:
    """``rows`` with ``passed`` and ``fail_reason``, the first assertion that fails.

    Columns: response, matched_pair, kw_raw, word_count, is_fallback, and the assertions
    contains (any), not_contains (none), pair_prefix, expect_fallback, min_words,
    min_kw_raw, null where there is none.
    """
    text = F.lower("response")
    holds = lambda a: F.exists(a, lambda w: F.contains(text, w))
    reason = (
        F.when(F.col("contains").isNotNull() & ~holds("contains"), "contains")
        .when(F.col("not_contains").isNotNull() & holds("not_contains"), "not_contains")
        .when(F.col("pair_prefix").isNotNull() & ~F.startswith(F.lower("matched_pair"), F.lower("pair_prefix")), "pair_prefix")
        .when(F.coalesce("expect_fallback", F.lit(False)) & ~F.col("is_fallback"), "expect_fallback")
        .when(F.col("word_count") < F.col("min_words"), "min_words")
        .when(F.col("kw_raw") < F.col("min_kw_raw"), "min_kw_raw")
    )
    return rows.withColumn("fail_reason", reason).withColumn("passed", F.col("fail_reason").isNull())


def answer_matches(answer: Column, expected: Column) -> Column:
    """Does the whole lower-case answer contain a match of the expected pattern?"""
    return F.regexp_like(F.lower(answer), expected)


def report(results: DataFrame) -> DataFrame:
    """Per category, in their order, and in all (null category, last): total, passed, rate,
    and the mean and largest time over positive times."""
    timed = F.when(F.col("response_time_ms") > 0, F.col("response_time_ms"))
    return results.rollup("category").agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        (F.count_if("passed") / F.count("*")).alias("rate"),
        F.avg(timed).alias("avg_ms"),
        F.max(timed).alias("max_ms"),
    ).orderBy(F.col("category").asc_nulls_last())  # a row per category


def verdict(results: DataFrame, category: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row: total, passed, rate, ok and exit_code (0 if ok) of the results, or of one
    category's. No results have rate 0."""
    used = results if category is None else results.where(F.col("category") == category)
    sums = used.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    rows = sums.withColumn("rate", F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)))
    return rows.withColumn("ok", F.col("rate") >= threshold).withColumn("exit_code", F.when(F.col("ok"), 0).otherwise(1))


def accuracy(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    return rows.agg(F.avg((F.col(predicted) == F.col(target)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def relative_error(rows: DataFrame, value: str, reference: str) -> DataFrame:
    """|X - R| / |R| in the Frobenius norm, of cells; null where R is zero or there are none."""
    gap = F.col(value) - F.col(reference)
    return rows.agg(F.try_divide(F.sqrt(F.sum(gap * gap)), F.sqrt(F.sum(F.col(reference) * F.col(reference)))).alias("relative_error"))


def phase_shares(rows: DataFrame, phase: str, seconds: str) -> DataFrame:
    """(phase, seconds, share): seconds per phase and their per cent of all."""
    sums = rows.groupBy(phase).agg(F.sum(seconds).alias("seconds"))
    total = sums.agg(F.sum("seconds").alias("total"))  # one row
    return sums.join(F.broadcast(total)).select(phase, "seconds", F.try_divide(100 * F.col("seconds"), F.col("total")).alias("share"))


def exact_median(rows: DataFrame, key: str, value: str, most: int = 10_000, pieces: int = 64) -> DataFrame:
    """(key, median, n): the middle value of each key, or the mean of the two, and its rows.

    Selection by ranks: approximate quantiles cut a key's values into ``pieces``, exact counts
    tell which piece has the wanted rank, and only that piece is looked into again, until it
    holds ``most`` values at most or equal ones only. No group holds a key's values, and what
    is shuffled are counts. Null values have no rank but count as rows; keys of null values
    alone have a null median.
    """
    base = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    sizes = tables.cut(base.groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    ranks = F.array_distinct(F.array(F.floor((F.col("held") - 1) / 2), F.floor(F.col("held") / 2)))
    # a row for a key and a rank: it lies among the ``held`` values from lo to hi, ``below`` are less
    state = sizes.where("held > 0").select("k", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "held", "lo", "hi")
    done = []

    def among(found: DataFrame, *columns: str) -> DataFrame:
        """Values of ``base`` from lo to hi of a state's rows, with columns of them."""
        met = base.where(F.col("v").isNotNull()).join(found.withColumnRenamed("k", "key"), F.col("k").eqNullSafe(F.col("key")) & F.col("v").between(F.col("lo"), F.col("hi")))
        return met.select("k", "rank", *columns, "v")

    def matched(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of one key and rank."""
        renamed = right.withColumnRenamed("k", "key").withColumnRenamed("rank", "at")
        return left.join(renamed, F.col("k").eqNullSafe(F.col("key")) & (F.col("rank") == F.col("at"))).drop("key", "at")

    while True:
        state = tables.cut(state, "ranks")
        narrow = (F.col("lo") == F.col("hi")) | (F.col("held") <= most)
        done.append(state.where(narrow))
        left = state.where(~narrow)
        if not left.limit(1).count():
            break
        cuts = F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 10_000).alias("cuts")
        second = F.max(F.when(F.col("v") < F.col("hi"), F.col("v"))).alias("second")  # so that a piece is always taken off
        edges = among(left, "hi").groupBy("k", "rank").agg(cuts, second)
        ends = F.array_append(F.filter(F.array_append("cuts", F.col("second")), lambda c: c < F.col("hi")), F.col("hi"))
        edged = tables.cut(matched(left, edges).withColumn("ends", F.array_distinct(ends)), "edges")
        piece = F.size(F.filter("ends", lambda e: e < F.col("v"))).alias("piece")
        counts = among(edged, "ends").groupBy("k", "rank", piece).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("c").over(W.partitionBy("k", "rank").orderBy("piece"))  # a row a piece
        start = F.col("below") + F.col("upto") - F.col("c")
        found = matched(left, counts.withColumn("upto", upto)).where((start <= F.col("rank")) & (F.col("rank") < start + F.col("c")))
        state = found.select("k", "rank", start.alias("below"), F.col("c").alias("held"), F.col("first").alias("lo"), F.col("last").alias("hi"))
    ends = reduce(DataFrame.union, done)
    few = among(ends.where("lo < hi"), "below").groupBy("k", "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # ``most`` values
    picked = ends.where("lo = hi").select("k", F.col("lo").alias("x")).union(few.select("k", F.get("vs", (F.col("rank") - F.col("below")).cast("int"))))
    middle = picked.groupBy("k").agg(F.avg("x").alias("median")).withColumnRenamed("k", "key")
    return sizes.join(middle, F.col("k").eqNullSafe(F.col("key")), "left").select(F.col("k").alias(key), "median", "n")
