"""Dialog pairs: pairing, tokens, generators, templates and keep-first dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import text as tx

# The arithmetic rows' wording.
SUMS = (("plus", ". einfache aufgabe . magst du noch eine"), ("minus", ". das war nicht so schwer . noch eine aufgabe"), ("mal", ". gut gerechnet . noch eine"))
RIGHT = ". gut gerechnet . noch eine aufgabe"


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, user, bot): user turns whose next turn is the assistant's."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", F.col("text").alias("user"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("bot"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "user", "bot")


def pair_tokens(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, token): ``du:`` words ``.`` ``bot:`` words ``.`` of each pair."""
    mark = lambda t: F.array(F.lit(t))
    row = F.concat(mark("du:"), tx.words(F.col("user")), mark("."), mark("bot:"), tx.words(F.col("bot")), mark("."))
    return pairs.select(*keys, F.posexplode(row).alias("i", "token"))


def pair_sentences(pairs: DataFrame, copies: int = 3) -> DataFrame:
    """Each pair as one token list with markers, ``copies`` times."""
    mark = lambda t: F.array(F.lit(t))
    row = F.concat(mark("du:"), tx.words(F.col("user")), mark("."), mark("bot:"), tx.words(F.col("bot")), mark("."))
    return pairs.select("*", row.alias("sentence")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given; other rows go. The minimum of the
    row as a struct is aggregated before the shuffle, so a hot key costs one row a task.
    String keys are compared by a 256-bit digest, so texts are no shuffle keys; of rows
    that are equal in the order the one with the smallest other columns stays."""
    kinds = dict(rows.dtypes)
    rest = [c for c in rows.columns if c not in order]
    by = [F.sha2(k, 256).alias(f"__k{i}") if kinds[k] == "string" else F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    least = rows.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return least.select("__first.*").select(*rows.columns)


def union_in_order(*parts: DataFrame, order: str = "pos") -> DataFrame:
    """All parts, one after the other: rows get their part's number and keep their place."""
    tagged = [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def arithmetic(spark: SparkSession, top: int = 10) -> DataFrame:
    """(user, bot): sums, differences (y <= x) and products (at most top squared)."""
    grid = spark.range(top + 1).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("y"))

    def row(k: int, result: Column, ok: Column) -> Column:
        word, tail = SUMS[k]
        user = F.format_string(f"was ist %d {word} %d", "x", "y")
        return F.when(ok, F.struct(user.alias("user"), F.format_string(f"%d {word} %d ist %d {tail}", "x", "y", result).alias("bot")))

    x, y = F.col("x"), F.col("y")
    rows = F.array(row(0, x + y, F.lit(True)), row(1, x - y, y <= x), row(2, x * y, x * y <= top * top))
    return grid.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def arithmetic_checks(spark: SparkSession, top: int = 10) -> DataFrame:
    """(user, bot): confirmations of given results; differences by a theta join."""
    a = spark.range(top + 1).select(F.col("id").cast("int").alias("x"))
    b = spark.range(top + 1).select(F.col("id").cast("int").alias("y"))

    def rows(k: int, result: Column, on: Column) -> DataFrame:
        word = SUMS[k][0]
        return a.join(F.broadcast(b), on).select(
            F.format_string(f"{word} %d %d %d", "x", "y", result).alias("user"),
            F.format_string(f"richtig . %d {word} %d ist %d {RIGHT}", "x", "y", result).alias("bot"),
        )

    x, y = F.col("x"), F.col("y")
    return rows(0, x + y, F.lit(True)).union(rows(1, x - y, y <= x)).union(rows(2, x * y, F.lit(True)))


def fill_templates(things: DataFrame, templates: list[tuple[str, str]], slot: str = "thing") -> DataFrame:
    """(thing, t, user, bot): every thing in every template's ``{}``. The templates are a
    literal list, so they ride along as an array."""
    rows = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(u).alias("u"), F.lit(b).alias("b")) for k, (u, b) in enumerate(templates)])
    out = things.select(slot, F.explode(rows).alias("r"))
    fill = lambda c: F.replace(F.col(c), F.lit("{}"), F.col(slot))
    return out.select(slot, F.col("r.t").alias("t"), fill("r.u").alias("user"), fill("r.b").alias("bot"))


def literal_pairs(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(pos, user, bot) of hand-written pairs, in their order."""
    return spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "pos long, user string, bot string")


def union_distinct(*parts: DataFrame) -> DataFrame:
    """All different rows of the parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def fill_slots(templates: list[tuple[str, str]], **slots: DataFrame) -> DataFrame:
    """(t, slots, user, bot): every combination of the slots' values in every template's
    ``{name}``. Slots are short tables of one column each, named like the slot."""
    rows = None
    for name, values in slots.items():
        own = values.select(name).distinct()
        rows = own if rows is None else rows.join(F.broadcast(own))  # lists of a few words each
    parts = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(u).alias("u"), F.lit(b).alias("b")) for k, (u, b) in enumerate(templates)])
    out = rows.select(*slots, F.explode(parts).alias("r"))

    def fill(c: str) -> Column:
        text = F.col(c)
        for name in slots:
            text = F.replace(text, F.lit("{" + name + "}"), F.col(name))
        return text

    return out.select(*slots, F.col("r.t").alias("t"), fill("r.u").alias("user"), fill("r.b").alias("bot"))


def unless_present(rows: DataFrame, present: DataFrame, key: str = "user") -> DataFrame:
    """Rows whose key isn't in ``present``."""
    return rows.join(present.select(key).distinct(), key, "left_anti")


def chain_turns(chains: DataFrame) -> DataFrame:
    """(chain_id, turn, user, bot) from a column ``turns`` of (user, bot) structs."""
    rows = chains.select("chain_id", F.posexplode("turns").alias("turn", "p"))
    return rows.select("chain_id", "turn", "p.user", "p.bot")


def flatten_map(rows: DataFrame, column: str) -> DataFrame:
    """(group, name, value) of a map of maps, in key order."""
    outer = rows.select(F.explode(column).alias("group", "inner"))
    return outer.select("group", F.explode("inner").alias("name", "value"))


def reuse_answers(aliases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(user, bot): aliases (user, answer_of) get the bot side of the pair numbered so."""
    return aliases.join(pairs.select(F.col("pair_id").alias("answer_of"), "bot"), "answer_of").select("user", "bot")


def last_bot_turn(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, text, last_bot, combined) of user turns: the assistant's last text
    before it, empty at first, and both joined by a space."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    said = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w)
    rows = conversations.withColumn("last_bot", F.coalesce(said, F.lit(""))).where("role = 'user'")
    return rows.select("conv_id", "turn", "text", "last_bot", F.trim(F.concat_ws(" ", "last_bot", "text")).alias("combined"))


def scale_corpus(toks: DataFrame, copies: int, length: int | Column) -> DataFrame:
    """The token sequence ``copies`` times in a row, positions going on."""
    n = length if isinstance(length, Column) else F.lit(length)
    return toks.select("token", "pos", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).withColumn("pos", F.col("pos") + F.col("copy") * n)


def sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement, the same ones for a seed however rows are dealt."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
