"""Secret scans with DataFrame functions only.

Base rules are regular expressions. Positions come from matching ``\\G(gap)(match)``: the
gaps' and matches' lengths add up to each match's place. The entropy rule takes runs of
key characters as candidates and slides a window over each one per character class,
with incremental symbol counts: sum(c log2 c) changes only by the symbol that enters and
the one that leaves, and a window's Shannon entropy is log2(W) - sum/W. Windows at or
above the class's threshold make a span from the first's start to the last's end, unless
an allow-list pattern covers the candidate or a base span overlaps it.

Everything is one narrow pass over the rows: no shuffle, no Python, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common

# Fixed by the rules' definition.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more characters in all
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more
ASSIGN_VALUE_MIN = 8

#: Candidate runs of the entropy rule, and its classes: name, full-match pattern of the
#: candidate, window length, least entropy in bits.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
CLASSES = (
    ("entropy_hex", r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+", 20, 2.9),
    ("entropy_mixed", r"(?=.*[0-9])(?=.*[A-Za-z])(?!^[0-9A-Fa-f]+$)[A-Za-z0-9+/_-]+", 20, 3.75),
    ("entropy_letters", r"(?=(?:(?:(?![a-z][A-Z]).)*+[a-z][A-Z]){3})[A-Za-z+/_-]+", 20, 3.9),
)
#: Candidates that match one of these are no secrets.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij|123456789",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
SYMBOLS = 80  # '+' to 'z'
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _empty() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def located(text: Column, pattern: str, kind: str, rank: int, value_min: int = 0, captured: bool = False) -> Column:
    """Spans of all matches, leftmost and non-overlapping, in code points. With
    ``captured``, matches whose own group is shorter than ``value_min`` are dropped."""
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps = F.transform(F.regexp_extract_all(text, whole, F.lit(1)), F.length)
    sizes = F.transform(F.regexp_extract_all(text, whole, F.lit(2)), F.length)
    kept = F.transform(F.regexp_extract_all(text, whole, F.lit(3 if captured else 2)), lambda v: F.length(v) >= value_min)
    rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("kept"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + row["size"]).alias("stop"), F.lit(kind).alias("kind"))
        return F.struct((start + row["size"]).alias("at"), F.when(row["kept"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), _empty().alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(rows, begin, step)["spans"]).otherwise(_empty())


def _weight(count: Column) -> Column:
    """c log2 c, 0 for no symbols."""
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def hot_stretch(candidate: Column, window: int, least: float) -> Column:
    """First and last end (1-based) of windows with enough entropy; 0 and 0 if none."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - 42)
    leaving = F.concat(F.array_repeat(F.lit(0), window), F.slice(codes, 1, F.greatest(F.length(candidate) - window, F.lit(0))))
    moves = F.zip_with(codes, leaving, lambda x, y: F.struct(x.alias("code"), y.alias("gone")))

    def step(state: Column, move: Column) -> Column:
        i, code, gone = state["i"] + 1, move["code"], move["gone"]
        into = F.element_at(state["counts"], code)
        plus = state["sum"] + _weight(into + 1) - _weight(into)
        left = F.when(gone > 0, F.element_at(state["counts"], F.greatest(gone, F.lit(1))) + F.when(gone == code, 1).otherwise(0)).otherwise(F.lit(0))
        total = plus - _weight(left) + _weight(F.greatest(left - 1, F.lit(0)))
        counts = F.transform(state["counts"], lambda x, j: x + F.when(j + 1 == code, 1).otherwise(0) - F.when(j + 1 == gone, 1).otherwise(0))
        hot = (i >= window) & (F.log2(F.lit(float(window))) - total / window >= least - 1e-9)
        return F.struct(
            i.alias("i"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hot & (state["first"] == 0), i).otherwise(state["first"]).alias("first"),
            F.when(hot, i).otherwise(state["last"]).alias("last"),
        )

    begin = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), SYMBOLS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(moves, begin, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of the entropy rule, before those that base spans overlap are dropped."""
    allowed = F.lit(False)
    found = located(text, CANDIDATE, "candidate", 0)

    def spans_of(rank: int, name: str, shape: str, window: int, least: float) -> Column:
        def one(c: Column) -> Column:
            candidate = F.substring(text, c["start"] + 1, c["stop"] - c["start"])
            banned = allowed
            for pattern in allow:
                banned = banned | candidate.rlike(pattern)
            fits = candidate.rlike(f"^(?:{shape})$") & ~banned
            return F.struct(c["start"].alias("at"), F.when(fits, hot_stretch(candidate, window, least)).alias("hot"))

        def span(x: Column) -> Column:
            return F.struct((x["at"] + x["hot"]["first"] - window).alias("start"), F.lit(rank).alias("rank"), (x["at"] + x["hot"]["last"]).alias("stop"), F.lit(name).alias("kind"))

        return F.transform(F.filter(F.transform(found, one), lambda x: x["hot"]["first"] > 0), span)

    parts = [spans_of(3 + k, *c) for k, c in enumerate(CLASSES)]
    return F.when(text.rlike(CANDIDATE), F.concat(*parts)).otherwise(_empty())


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secret_spans", base_into: str = "secret_base") -> DataFrame:
    """``docs`` with two array columns of spans (start, rank, stop, kind) in code points,
    sorted by start and kind: all spans and the base ones.

    Null and empty texts have no spans. Every row is kept, repeated ones too. Columns of
    the two names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(located(t, ASSIGN, "assign", 0, ASSIGN_VALUE_MIN, captured=True), located(t, ACCESS, "access", 1), located(t, HEX, "hex", 2)))
    more = F.filter(entropy_spans(t), lambda s: ~F.exists(F.col(base_into), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return docs.withColumn(base_into, base).withColumn(into, F.array_sort(F.concat(F.col(base_into), more)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_digests(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    found = find_secrets(docs.select(F.col(by).cast("long").alias("doc_id"), F.col(text).alias("text")))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("secret_base")), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans make one mark.
    Null texts stay null; texts without spans stay as they are; other columns may have any
    names and stay."""
    t = F.col(text)
    spans, base = common.free_name(docs.columns, "spans"), common.free_name(docs.columns, "base")

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] >= state["at"]
        piece = F.concat(F.substring(t, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), F.when(apart, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(F.col(spans), begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.length(t))))
    found = find_secrets(docs, text, spans, base)
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).drop(spans, base)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secret_digests(common.documents(spark, sf_dir))
