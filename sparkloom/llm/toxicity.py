"""Toxicity by weak supervision.

Voters look at a text: lexicons by what they attack and in which language, lexicons mined
from labelled rows (whole words, and word beginnings of 3 to 6 letters), and surface
patterns. A mined voter judges a row by what the other folds' labels have told, so no
row's label reaches its own votes, and labels are used nowhere else.

A generative label model explains the votes by an unknown class: every voter has rates of
its votes per class (its accuracies), and voters that depend on each other beyond the
class are tied in a tree, with the rates of one given the other's vote (its correlations).
Expectation maximization fits both; the tree is the maximum spanning forest of the
conditional mutual information. A logistic regression over the lexicons' features, seeds
and mined ones, learns from the posteriors. Texts are scored by the regression alone, in
one narrow pass.

A feature is a whole word, or a word's first 3 to 6 letters, present or not. Features are
64-bit hashes, and training keeps as many as are significant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, encoding
from sparkloom.llm.langid import letters

PREFIXES = (3, 4, 5, 6)
KINDS = ("word", *(f"first {k}" for k in PREFIXES))
#: Labelled rows that training reads, about (a hash of the id decides), and its folds.
SAMPLE_ROWS = 6_000
FOLDS = 5
#: How sure a mined feature has to be: toxic rows with it, z score, lift.
MINED_ROWS, MINED_Z, MINED_RATIO = 3, 4.0, 10.0
#: Voters are tied if twice the rows times their conditional mutual information exceeds this.
TIE = 30.0
#: Share of a voter's entropy that the other's vote has to settle, for the first rounds of
#: the fit and for the ones after; then the tree is kept.
TIED_PART, SETTLE = (0.2, 0.1), 10
#: Characters that are hashed at once.
PORTION = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Seed lexicons of abusive words, by what they attack and by language.
LEXICONS = {
    "intelligence en": "idiot idiots moron morons stupid imbecile dumb dumbass dunce fool dimwit halfwit",
    "intelligence de": "dummkopf idiotisch blödmann trottel schwachkopf",
    "intelligence fr": "idiote imbécile abruti crétin débile",
    "intelligence es": "idiota imbécil tonto estúpido cretino",
    "worth en": "worthless loser losers scum trash garbage filth vermin pathetic useless nobody",
    "worth de": "abschaum versager taugenichts",
    "worth fr": "ordure déchet minable",
    "worth es": "basura escoria inútil",
    "ridicule en": "clown clowns joke buffoon freak weirdo crybaby",
    "ridicule de": "hanswurst witzfigur",
    "ridicule fr": "bouffon guignol",
    "ridicule es": "payaso bufón",
    "disgust en": "disgusting revolting repulsive gross vile sickening nasty",
    "disgust de": "ekelhaft widerlich abscheulich",
    "disgust fr": "dégoûtant répugnant écoeurant",
    "disgust es": "asqueroso repugnante",
    "hostility en": "hate hateful kill shut",
    "hostility de": "hass tötet verrecke",
    "hostility fr": "haine tuer crève",
    "hostility es": "odio matar muérete",
    "profanity en": "crap damn bastard bitch asshole shit fuck fucking",
    "profanity de": "arschloch scheiße",
    "profanity fr": "merde connard",
    "profanity es": "mierda cabrón",
}
SURFACE = ("shouting", "triple mark", "masked word", "drawn out", "many marks", "several seeds")
_SPACE, _DRAWN = re.compile(r"\s"), re.compile(r"(\w)\1{3,}")
#: A word with its middle or end in stars or other marks: f***, s**t, i@#$%.
_MASKED = re.compile(r"(?<!\w)[^\W\d_](?:\*{2,}|[@#$%&*!]{3,})[^\W\d_]{0,2}(?!\w)")


def _groups(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """(first text, texts): several texts of about ``most`` characters together, or a piece
    of a longer one, cut where there is white space."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > most:
            a, text = 0, texts[at]
            while a < len(text):
                gap = _SPACE.search(text, min(a + most, len(text)))
                b = gap.start() + 1 if gap else len(text)
                yield at, [text[a:b]]
                a = b
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= most:
            size += len(texts[to]) + 1
            to += 1
        yield at, texts[at:to]
        at = to


def features(texts: list[str], most: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, kind, feature) of every word's features, repeats included, some texts
    at a time. Words are runs of letters, in lower case, of any length."""
    for first, group in _groups(texts, most):
        codes = np.frombuffer("".join(f"{t} " for t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = letters().of(codes).astype(np.uint64)
        inside = low != 32
        start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        end = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
        bounds = np.cumsum([len(t) + 1 for t in group])
        who = (np.searchsorted(bounds, start, "right") + first).astype(np.int32)
        with np.errstate(over="ignore"):
            power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(low.size, STEP))])
            undo = np.concatenate([[np.uint64(1)], np.cumprod(np.full(low.size, BACK))])
            total = np.concatenate([[np.uint64(0)], np.cumsum(low * power[:-1])])
            for kind, size in enumerate((0, *PREFIXES)):
                long = (end - start >= size) if size else np.ones(start.size, bool)
                a = start[long]
                b = a + size if size else end[long]
                h = (total[b] - total[a]) * undo[a] + np.uint64(kind) * np.uint64(0x85EBCA6B27D4EB2F)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(29)
                yield who[long], np.full(a.size, kind, np.int8), h.view(np.int64)


def word_feature(word: str) -> int:
    """Feature of a whole word."""
    return int(next(features([word]))[2][0])


def lexicons() -> dict[str, np.ndarray]:
    return {name: np.unique([word_feature(w) for w in words.split()]) for name, words in LEXICONS.items()}


def surface(text: str, seeds: int) -> list[int]:
    """Votes of the surface patterns: 1 toxic, 0 not, -1 abstains. ``seeds``: distinct
    lexicon words found."""
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        1 if len(text) >= 40 and capitals > 0.5 * len(text) else -1,
        1 if "!!!" in text else -1,
        1 if _MASKED.search(text) else -1,
        1 if _DRAWN.search(text) else -1,
        1 if text.count("!") > 0.01 * len(text) else -1,
        1 if seeds >= 2 else -1,
    ]


class Known:
    """A set of features: a small bit table lets most others go at once."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.codes & 0xFFFFF] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``found`` are known, and their places."""
        at = np.flatnonzero(self.table[found & 0xFFFFF])
        place = np.minimum(np.searchsorted(self.codes, found[at]), self.codes.size - 1)
        hit = self.codes[place] == found[at]
        return at[hit], place[hit]


@dataclass
class Scorer:
    """Features' weights; ``told`` has the label model's parameters, for a look."""

    known: Known
    weight: np.ndarray
    bias: float
    told: dict = field(default_factory=dict)

    def score(self, texts: list[str]) -> np.ndarray:
        total, n = np.full(len(texts), self.bias), self.weight.size
        pairs = [np.zeros(0, np.int64)]
        for who, _, found in features(texts):
            at, place = self.known.find(found)
            pairs.append(np.unique(who[at].astype(np.int64) * n + place))
        for p in (np.unique(np.concatenate(pairs)),):  # a feature counts once in a text
            total += np.bincount(p // max(n, 1), self.weight[p % max(n, 1)] if p.size else None, minlength=len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def label_model(votes: np.ndarray, rounds: int = 60, tie: float = TIE) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 from votes (1, 0, or -1 for none) alone, and the parameters.

    Class 1 is the one in which votes of 1 are more frequent. A small pseudo-count keeps
    voters weakly informative. Without rows the posterior is empty.
    """
    n, m = votes.shape
    shown = np.stack([(votes == v) for v in (-1, 0, 1)], axis=2).reshape(n, 3 * m).astype(np.float64)
    hit = (votes == 1).astype(float)
    spread = hit - hit.mean(0) if n else hit
    scale = np.sqrt((spread**2).mean(0)) + 1e-9 if n else np.ones(m)
    alike = np.clip(np.abs(spread.T @ spread / max(n, 1) / np.outer(scale, scale)), 0, 1)
    np.fill_diagonal(alike, 1)
    p = 1 / (1 + np.exp(2 - 4 * (spread / alike.sum(1)).sum(1)))  # voters that move together share a say
    # before any row, a voter votes as it does in all rows, toxic votes more often in class 1
    usual = (shown.sum(0).reshape(m, 3) + 0.5) / (n + 1.5)
    tilts = [x / x.sum(1, keepdims=True) for x in (usual * (0.8, 0.5, 4.0), usual * (1.0, 1.5, 0.5))]
    parent, rates = np.full(m, -1), []
    for k in range(rounds):
        rates, pairs = [], []
        for w, tilt in ((p, tilts[0]), (1 - p, tilts[1])):
            joint = (shown.T @ (w[:, None] * shown)).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
            one = joint[np.arange(m), np.arange(m)][:, np.arange(3), np.arange(3)] + 2 * tilt
            one /= one.sum(1, keepdims=True)
            both = joint + 2 * one[:, None, :, None] * one[None, :, None, :]
            rates.append(one)
            pairs.append((both / both.sum((2, 3), keepdims=True), w.sum()))
        if k < 2 * SETTLE:  # later rounds keep the tree; the first ones tie near copies only
            gain = sum(share * (q * np.log(q / (one[:, None, :, None] * one[None, :, None, :]))).sum((2, 3)) for (q, share), one in zip(pairs, rates, strict=True))
            own = sum(share * -(one * np.log(one)).sum(1) for (_, share), one in zip(pairs, rates, strict=True))
            part = gain / (np.minimum(own[:, None], own[None, :]) + 1e-9)
            parent = _forest(np.where(part >= TIED_PART[k // SETTLE], 2 * gain, 0), tie)
        like = []
        for (q, _), one in zip(pairs, rates, strict=True):
            total = np.zeros(n)
            for j in range(m):
                if parent[j] < 0:
                    total += np.log(one[j])[votes[:, j] + 1]
                else:
                    given = q[j, parent[j]] / q[j, parent[j]].sum(0, keepdims=True)  # rates of j per vote of its parent
                    total += np.log(given)[votes[:, j] + 1, votes[:, parent[j]] + 1]
            like.append(total)
        base = np.clip(p.mean(), 1e-3, 0.5) if n else 0.5
        now = 1 / (1 + np.exp(-np.clip(np.log(base / (1 - base)) + like[0] - like[1], -30, 30)))
        still = n == 0 or np.abs(now - p).max() < 1e-4
        p = now
        if still:
            break
    return p, {"rates_1": rates[0].tolist() if rates else [], "rates_0": rates[1].tolist() if rates else [], "parent": parent.tolist()}


def _forest(gain: np.ndarray, least: float) -> np.ndarray:
    """Parents in the maximum spanning forest of the pairs with a gain over ``least``."""
    m = len(gain)
    parent, seen = np.full(m, -1), np.zeros(m, bool)
    for root in range(m):
        if seen[root]:
            continue
        seen[root] = True
        reach, come = gain[root].copy(), np.full(m, root)
        while True:
            reach[seen] = -np.inf
            j = int(np.argmax(reach))
            if reach[j] <= least:
                break
            seen[j], parent[j] = True, come[j]
            closer = gain[j] > reach
            reach[closer], come[closer] = gain[j][closer], j
    return parent


def regression(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, ridge: float = 0.1, rounds: int = 2_000) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradients; features are 0 or 1."""
    n, free = target.size, 1e-2

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, w[columns], minlength=n) + w[width] if rows.size else np.full(n, w[width])

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, g[rows], minlength=width) if rows.size else np.zeros(width), g.sum())

    penalty = np.append(np.full(width, ridge), free)
    v = np.ones(width + 1) / np.sqrt(width + 1)
    for _ in range(50):
        u = back(forward(v))
        size = np.linalg.norm(u)
        v = u / max(size, 1e-12)
    step = 1 / (0.3 * size + ridge)
    w = ahead = np.zeros(width + 1)
    t = 1.0
    for _ in range(rounds):
        slope = back(1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30))) - target) + penalty * ahead
        now, t_now = ahead - step * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        if slope @ (now - w) > 0:  # overshot: start the momentum anew
            t_now = 1.0
        ahead = now + (t - 1) / t_now * (now - w)
        if np.abs(now - w).max() < 1e-6:
            w = now
            break
        w, t = now, t_now
    return w[:width], float(w[width])


def lexicon_scorer() -> Scorer:
    """What is used without labelled rows: every seed word weighs the same."""
    known = Known(np.concatenate(list(lexicons().values())))
    return Scorer(known, np.full(known.codes.size, 2.0), -1.5)


def feature_counts(rows: DataFrame) -> DataFrame:
    """(kind, feature, n0 ... ): rows with a feature per fold and label, of rows of text,
    toxic (0 or 1) and fold. Cell 2 * fold + toxic."""

    def run(batches):
        for batch in encoding.slices(batches, "text", PORTION):
            cell = 2 * batch.column("fold").to_numpy() + batch.column("toxic").to_numpy()
            seen: dict[int, list] = {k: [] for k in range(len(KINDS))}
            for who, kind, found in features(batch.column("text").to_pylist()):
                if kind.size:
                    pairs = np.unique(np.stack([found, who.astype(np.int64)], axis=1), axis=0)
                    seen[int(kind[0])].append(pairs)
            for kind, parts in seen.items():
                if parts:
                    pairs = np.unique(np.concatenate(parts), axis=0)  # a long text's pieces
                    own, n = np.unique(np.stack([pairs[:, 0], cell[pairs[:, 1]]], axis=1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own[:, 0].copy()), pa.array(own[:, 1].astype(np.int32)), pa.array(n, pa.int64())], ["kind", "feature", "cell", "n"])

    counts = rows.select("text", "toxic", "fold").mapInArrow(run, "kind int, feature long, cell int, n long")
    sums = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(2 * FOLDS)]
    return counts.groupBy("kind", "feature").agg(*sums)


def significant(toxic: np.ndarray, other: np.ndarray, rows_1: int, rows_0: int) -> np.ndarray:
    """Is a feature with so many toxic and other rows evidence of toxicity?"""
    n1, n0 = max(rows_1, 1), max(rows_0, 1)
    share = (toxic + other) / (n1 + n0)
    z = (toxic - n1 * share) / np.sqrt(n1 * share * (1 - share) * n0 / (n1 + n0) + 1e-9)
    return (toxic >= MINED_ROWS) & (z > MINED_Z) & (toxic * n0 > MINED_RATIO * other * n1)


def votes_of(rows: DataFrame, known: Known) -> DataFrame:
    """(fold, hits, surface): known features of each row and the surface patterns' votes."""
    shared = rows.sparkSession.sparkContext.broadcast((known, np.unique(np.concatenate(list(lexicons().values())))))

    def run(batches):
        for batch in encoding.slices(batches, "text", PORTION):
            have, seeds = shared.value
            texts = batch.column("text").to_pylist()
            hits: list[list] = [[] for _ in texts]
            for who, _, found in features(texts):
                at, _ = have.find(found)
                for i, f in zip(who[at].tolist(), found[at].tolist(), strict=True):
                    hits[i].append(f)
            distinct = [np.unique(np.array(h, np.int64)) for h in hits]
            shown = [surface(t, int(np.isin(h, seeds).sum())) for t, h in zip(texts, distinct, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), pa.array(distinct, pa.list_(pa.int64())), pa.array(shown, pa.list_(pa.int32()))], ["fold", "hits", "surface"])

    return rows.select("text", "fold").mapInArrow(run, "fold int, hits array<long>, surface array<int>")


def fit(rows: DataFrame) -> Scorer:
    """Fit on rows of text, toxic and fold. The driver gets the features that may be
    significant and each row's known features, no texts."""
    sizes = np.zeros(2 * FOLDS, np.int64)
    for r in rows.groupBy((2 * F.col("fold") + F.col("toxic")).alias("c")).agg(F.count("*").alias("n")).collect():
        sizes[r["c"]] = r["n"]
    if not sizes.any():
        return lexicon_scorer()
    n1, n0 = sizes[1::2].sum(), sizes[::2].sum()
    toxic, other = (sum(F.col(f"n{c}") for c in range(b, 2 * FOLDS, 2)) for b in (1, 0))
    table = feature_counts(rows).where((toxic >= MINED_ROWS) & (toxic * int(max(n0, 1)) > other * int(max(n1, 1)))).orderBy("kind", "feature").toArrow()
    kind, code = table["kind"].to_numpy(), table["feature"].to_numpy()
    cells = np.stack([table[f"n{c}"].to_numpy() for c in range(2 * FOLDS)], axis=1) if len(code) else np.zeros((0, 2 * FOLDS), np.int64)
    sure = significant(cells[:, 1::2].sum(1), cells[:, ::2].sum(1), n1, n0)
    without = []  # what a fold's rows are judged by
    for f in range(FOLDS):
        rest = np.delete(np.arange(FOLDS), f)
        without.append(significant(cells[:, 2 * rest + 1].sum(1), cells[:, 2 * rest].sum(1), sizes[2 * rest + 1].sum(), sizes[2 * rest].sum()))
    seeds = lexicons()
    chosen = Known(np.concatenate([*seeds.values(), code[sure]]))
    shown = votes_of(rows, Known(np.concatenate([chosen.codes, *[code[w] for w in without]]))).toArrow()
    fold, hits = shown["fold"].to_numpy(), shown["hits"].combine_chunks()
    flat, who = hits.flatten().to_numpy(), np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy())

    def hit_by(codes: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        use = np.isin(flat, codes) & (True if of is None else of[who])
        return np.bincount(who[use], minlength=len(hits))

    columns = [np.where(hit_by(own) > 0, 1, -1) for own in seeds.values()]
    for k in range(len(KINDS)):  # mined: one feature, or several, or none is a vote
        found = sum(hit_by(code[without[f] & (kind == k)], fold == f) for f in range(FOLDS))
        columns += [(found > 0).astype(np.int64), (found > 1).astype(np.int64)]
    votes = np.column_stack([*columns, np.array(shown["surface"].to_pylist()).reshape(len(hits), len(SURFACE))])
    posterior, told = label_model(votes)
    told["voters"] = [*seeds, *(f"{n} mined {k}" for k in KINDS for n in ("a", "several")), *SURFACE]
    at, place = chosen.find(flat)
    weight, bias = regression(who[at], place, posterior, chosen.codes.size)
    return Scorer(chosen, weight, bias, told)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Fit on documents with a label whose crc32(doc_id as text) mod 5 is not 0.

    About ``sample_rows`` of them at most are read, whole; a document with several labels
    is toxic if one says so. Null labels and null ids teach nothing; null texts neither.
    Without labelled rows the lexicons alone decide.
    """
    held = common.crc32_of_id() % 5
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(held != 0)
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    size = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    chosen = known.where(draw < min(1.0, sample_rows / max(size, 1)))
    # the sample is bounded, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    return fit(common.cut(rows.select("text", "toxic", fold), "labelled"))


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", into: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with a score column (0 to 1); null and empty texts
    get the score of a text without any known feature. A column of that name is replaced;
    other columns may have any names. Every row is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    base = docs.drop(into)
    names = [c for c in (keep or base.columns) if c != into]
    fields = [f for n in names for f in base.schema.fields if f.name == n]
    source = f"c{names.index(text)}" if text in names else "__text"

    def run(batches):
        for batch in encoding.slices(batches, source, PORTION):
            score = shared.value.score([t or "" for t in batch.column(source).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in range(len(names))), pa.array(score)], [*(f"c{k}" for k in range(len(names))), "__s"])

    # inside, columns go by number: names of the table can't clash with ours
    q = lambda n: F.col(f"`{n}`")
    sent = [q(n).alias(f"c{k}") for k, n in enumerate(names)] + ([] if text in names else [q(text).alias("__text")])
    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)), "__s double"])
    return base.select(*sent).mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], F.col("__s").alias(into))


def predictions(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Every row is kept; an empty table
    gives no rows; without any label the lexicons alone decide."""
    scorer = train(docs, labels, sample_rows)
    held = F.coalesce(common.crc32_of_id() % 5 == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held, "text")
    done = scored(rows, scorer, into="score", keep=["doc_id", "held_out"])
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return predictions(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
