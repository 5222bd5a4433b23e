"""Text functions on columns; everything stays in the JVM unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizers' umlaut spelling and punctuation.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "ae", "Ö": "oe", "Ü": "ue", "ß": "ss"}
PUNCTUATION = r"([.,!?;:])"

# Question words, question prefixes and prompt words per language.
QUESTION_WORDS = {
    "de": ["was", "wie", "warum", "wo", "wer", "wann", "welches"],
    "en": ["what", "how", "why", "where", "who", "when", "which"],
}
QUESTION_PREFIX = {"de": ["was", "bedeutet"], "en": ["what", "is"]}
PROMPT_WORDS = {"de": ("kontext", "frage"), "en": ("context", "question")}
EXPLAIN_WORD = {"de": "erklaere", "en": "explain"}

# Entities that the JVM-side unescape knows by name; ``&amp;`` goes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def words(text: Column, pattern: str = r"\s+") -> Column:
    """Parts between matches of ``pattern``, empty ones dropped; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda t: t != "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return words(F.lower(text), "[^a-z0-9]+")


def spell_umlauts(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), UMLAUTS.items(), text)


def tokens_a(text: Column, limit: int | None = None) -> Column:
    """Filter first, then set punctuation apart."""
    kept = F.regexp_replace(F.lower(spell_umlauts(text)), r"[^a-z0-9.,!?;:'\-]", " ")
    found = words(F.regexp_replace(kept, PUNCTUATION, " $1 "), " +")
    return F.slice(found, 1, limit) if limit else found


def tokens_b(text: Column) -> Column:
    """Set punctuation apart first, then filter."""
    apart = F.regexp_replace(F.lower(spell_umlauts(text)), PUNCTUATION, " $1 ")
    return words(F.regexp_replace(apart, r"[^a-z0-9.,!?;:'\-]", " "), " +")


def right_strip(text: Column, characters: str) -> Column:
    """Any run of the characters at the end goes."""
    return F.regexp_replace(text, f"[{characters}]+$", "")


def unescape_common(text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """Those entities, one after the other, with their semicolons."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), entities.items(), text)


def entity_table() -> dict[str, str]:
    """Every name that HTML5 defines, with and without its semicolon, from the standard
    library's table."""
    from html.entities import html5

    return dict(html5)


def unescape_all(text: Column) -> Column:
    """Every named and numeric entity, in the JVM. Texts without an ampersand stay as they
    are; others are split before each one, and each part's entity is looked up: the longest
    name that begins there, decimal and hexadecimal numbers."""
    table = entity_table()
    longest = max(map(len, table))
    # names as a sorted literal array and their texts: an array look-up by position
    names = sorted(table)
    keys, values = (F.split(F.lit("\x00".join(x)), "\x00") for x in (names, [table[n] for n in names]))
    # numbers of the second control block mean its windows-1252 characters
    swapped = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}

    def number(part: Column) -> Column:
        digits, hexed = F.regexp_extract(part, r"^&#([0-9]+);?", 1), F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]+);?", 1)
        code = F.when(digits != "", digits.try_cast("long")).otherwise(F.conv(hexed, 16, 10).try_cast("long"))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | code.isNull()
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, r"^&#([xX][0-9a-fA-F]+|[0-9]+);?", "")
        gone = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | ((code % 65536) >= 65534)) & (code <= 0x10FFFF)
        old = F.element_at(F.array(*[F.lit(swapped[b]) for b in sorted(swapped)]), (code - 0x7F).cast("int"))
        return F.concat(F.when(bad, "\ufffd").when(gone, "").when(code.between(0x80, 0x9F), old).otherwise(wide), rest)

    def named(part: Column) -> Column:
        word = F.regexp_extract(part, r"^&([A-Za-z][A-Za-z0-9]{0,%d};?)" % (longest - 1), 1)
        # most names end in a semicolon; a few old ones may stand without and end anywhere
        sizes = F.filter(F.sequence(F.length(word), F.lit(2), F.lit(-1)), lambda n: F.array_contains(keys, F.substring(word, F.lit(1), n)))
        size = F.get(sizes, F.lit(0))
        found = F.element_at(values, F.array_position(keys, F.substring(word, F.lit(1), size)).cast("int"))
        return F.when((F.length(word) < 2) | size.isNull(), part).otherwise(F.concat(found, F.substring(part, size + 2, F.length(part))))

    def one(part: Column) -> Column:
        usual = F
        for name in ENTITIES:
            if name[1] != "#":
                usual = usual.when(part.startswith(name), F.concat(F.lit(table[name[1:]]), F.substring(part, F.lit(len(name) + 1), F.length(part))))
        return usual.when(part.rlike(r"^&#([0-9]|[xX][0-9a-fA-F])"), number(part)).when(part.rlike("^&[A-Za-z]"), named(part)).otherwise(part)

    parts = F.split(text, "(?=&)")
    return F.when(~text.contains("&"), text).otherwise(F.array_join(F.transform(parts, one), ""))


def strip_tags(html: Column, blocks: tuple[str, ...] = ("script", "style", "svg"), all_entities: bool = True, entities: dict[str, str] = ENTITIES) -> Column:
    """Drop whole blocks, turn tags into spaces, resolve entities (``entities`` only if not
    ``all_entities``), collapse white space."""
    text = reduce(lambda c, b: F.regexp_replace(c, rf"(?is)<{b}\b[^>]*>.*?</{b}>", " "), blocks, html)
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    text = unescape_all(text) if all_entities else unescape_common(text, entities)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_page(html: Column, all_entities: bool = True, entities: dict[str, str] = ENTITIES) -> Column:
    """As :func:`strip_tags`, without navigation, header and footer too."""
    return strip_tags(html, ("script", "style", "svg", "nav", "header", "footer"), all_entities, entities)


def put_between(text: Column, start: str, stop: str, new: Column) -> Column:
    """``text`` with ``new`` in place of all from the first ``start`` to the next ``stop``,
    which stays; as it is where either is missing. Null texts stay null."""
    at = F.instr(text, start)
    upto = F.locate(stop, text, 1) if start == stop else F.instr(F.substring(text, at + len(start), F.length(text)), stop)
    end = at + len(start) - 1 + upto
    whole = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, end, F.length(text)))
    return F.when((at > 0) & (upto > 0), whole).otherwise(text)


def snippet(text: Column, limit: int = 80) -> Column:
    return F.array_join(tokens_a(text, limit), " ")


def first_sentences(text: Column, n: int = 3, max_words: int = 60) -> Column:
    """Tokens up to the n-th full stop, the whole text if there is none, at most
    ``max_words`` (then closed by a stop); the result ends in a stop."""

    def of(t: Column) -> Column:
        # place of the n-th stop, of the last one if there are fewer, 0 if there is none
        stops = F.filter(F.transform(t, lambda x, i: F.when(x == ".", i + 1)), lambda i: i.isNotNull())
        end = F.element_at(F.concat(F.array(F.lit(0)), stops), F.least(F.size(stops), F.lit(n)) + 1)
        kept = F.when(end > 0, F.slice(t, 1, F.greatest(end, F.lit(1)))).otherwise(t)
        return F.when(F.size(kept) > max_words, F.concat(F.slice(kept, 1, max_words), F.array(F.lit(".")))).otherwise(kept)

    joined = F.transform(F.array(tokens_a(text)), lambda t: F.array_join(of(t), " "))[0]
    return F.when(joined.endswith("."), joined).otherwise(F.concat(joined, F.lit(" .")))


def language_of_path(path: Column) -> Column:
    return F.when(path.contains("/en/"), "en").otherwise("de")


def question_of_heading(heading: Column, lang: Column) -> Column:
    """Question tokens: a heading that ends in ? as it is, else with a prefix unless it
    begins with a question word, and ? at the end; no tokens, no question."""
    h = F.trim(heading)
    t = tokens_a(h)
    asks = F.array(F.lit("?"))

    def build(code: str) -> Column:
        prefix = F.array(*map(F.lit, QUESTION_PREFIX[code]))
        return F.when(F.element_at(t, 1).isin(QUESTION_WORDS[code]), F.concat(t, asks)).otherwise(F.concat(prefix, t, asks))

    full = F.when(lang == "de", build("de")).otherwise(build("en"))
    return F.when(h.endswith("?"), t).when(F.size(t) == 0, F.expr("cast(array() as array<string>)")).otherwise(full)


def prompt(context: Column, question: Column, lang: Column) -> Column:
    """Retrieval prompt: the context's word, the context, the question's word, the question."""
    de, en = PROMPT_WORDS["de"], PROMPT_WORDS["en"]
    first, second = F.when(lang == "de", de[0]).otherwise(en[0]), F.when(lang == "de", de[1]).otherwise(en[1])
    return F.concat_ws(" ", first, context, second, question)
