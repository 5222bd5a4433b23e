from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import sections, vocab


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_tokenizers(spark):
    texts = ["Grüße, Straße! it's 3.5 – ok?", "", None, "A–B", "Ärger;Übel:Öl"]
    assert values(spark, texts, tx.tokens_a(F.col("text"))) == [["gruesse", ",", "strasse", "!", "it's", "3", ".", "5", "ok", "?"], [], [], ["a", "b"], ["aerger", ";", "uebel", ":", "oel"]]
    assert values(spark, texts[:1], tx.tokens_b(F.col("text"))) == [["gruesse", ",", "strasse", "!", "it's", "3", ".", "5", "ok", "?"]]
    assert values(spark, texts[:1], tx.tokens_a(F.col("text"), 2)) == [["gruesse", ","]]


def test_first_sentences(spark):
    texts = ["one two. three. four. five.", "no stop here", "", "a b c d e f.", "one. rest without stop"]
    assert values(spark, texts, tx.first_sentences(F.col("text"), 3, 60)) == ["one two . three . four .", "no stop here .", " .", "a b c d e f .", "one ."]
    assert values(spark, texts[3:4], tx.first_sentences(F.col("text"), 3, 4)) == ["a b c d ."]


def test_questions(spark):
    heads = ["What is it?", "Kernel trick", "How it works", "", "???"]
    q = lambda lang: values(spark, heads, tx.question_of_heading(F.col("text"), F.lit(lang)))
    assert q("en") == [["what", "is", "it", "?"], ["what", "is", "kernel", "trick", "?"], ["how", "it", "works", "?"], [], ["?", "?", "?"]]
    assert q("de")[1] == ["was", "bedeutet", "kernel", "trick", "?"]


def test_strip_tags(spark):
    html = ["<p>a&amp;lt;b</p><SCRIPT x>1<2</script><style>\n.x{}</style> c&nbsp;d", "<svg>\n<x></svg>plain &quot;q&quot; &#228;"]
    assert values(spark, html, tx.strip_tags(F.col("text"))) == ["a&lt;b c d", 'plain "q" ä']
    assert values(spark, html[1:], tx.strip_tags(F.col("text"), all_entities=False)) == ['plain "q" &#228;']
    assert values(spark, ["<nav>x</nav><header>y</header>z<footer>w</footer>"], tx.strip_page(F.col("text"))) == ["z"]


ENTITIES = [
    None, "", "no entity", "&", "&&amp;", "&amp;lt;", "a &eacute; b &Eacute;&nbsp;&copy;", "&notit; &not; &notin;", "&#228;&#xE4;&#Xe4; &#128; &#0; &#x110000; &#xD800;", "&#65 &#x41g &#; &#x;",
    "&AMP;&amp &ampx &unknown; &ThickSpace;x &fjlig; &amp;amp;", "1&2;3 &lt;p&gt; &#128512; &#x1F600;", "&copy2020 &regular; &times2", "&CounterClockwiseContourIntegral; &acE;", "&#150;&#x81;&#12;&#13;&#xFFFE; &#1;",
]


def test_every_entity(spark):
    import html

    assert values(spark, ENTITIES, tx.unescape_all(F.col("text"))) == [t if t is None else html.unescape(t) for t in ENTITIES]
    names = [f"x&{n}y" for n in tx.entity_table()]
    assert values(spark, names, tx.unescape_all(F.col("text"))) == [html.unescape(n) for n in names]


LONG = "word " * 31
PAGE = f"""<html><nav><h2>menu</h2>{LONG}</nav><h1>Title</h1>{LONG}
<h2 class="a">First <b>head</b></h2><p>{LONG}kernel kernel. End.</p><H3>Second?</H3>{LONG}<h2>Short</h2>few words
<h3>Broken</h2>{LONG}<h2>Last</h2>{LONG}tail<footer>{LONG}</footer></html>"""


WANT = [("a/en/x.html", "First head"), ("a/en/x.html", "Second?"), ("a/en/x.html", "Short"), ("a/en/x.html", "Last"), ("d.html", "Only")]


def test_sections(spark):
    df = spark.createDataFrame([("a/en/x.html", PAGE), ("b.html", None), ("c.html", "<p>no heads</p>"), ("d.html", "<h2>Only</h2>" + LONG)], "url string, html string")
    got = [(r["url"], r["heading"]) for r in sections.sections(df).orderBy("url", "place").collect()]
    assert got == WANT
    pairs = sections.section_pairs(sections.sections(df).where("heading = 'First head'")).orderBy("kind").collect()
    assert [r["user"][:24] for r in pairs][:1] == ["what is first head"]
    assert [r["kind"] for r in pairs] == [0, 1, 2, 3, 4] and [r["user"] for r in pairs[3:]] == ["what is word", "what is kernel"]
    assert pairs[1]["user"].startswith("context word word") and pairs[1]["user"].endswith("question what is first head")


def test_counts_keywords_and_chunks_inside_the_row(spark):
    words = ["b", "a", "b", "kernel", "the", "zeta", "alpha", "zeta", "alpha", "is", "ab"] * 7
    texts = [" ".join(words), "", None, "x", "! ?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    toks = vocab.tokens(df)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(vocab.row_counts(df)) == rows(vocab.token_counts(toks))
    assert rows(vocab.row_keywords(df, 3)) == rows(vocab.keywords(toks, 3))
    assert rows(vocab.row_chunks(df, 10)) == rows(vocab.fixed_chunks(toks, 10))


def test_keywords_ties_and_boost(spark):
    df = spark.createDataFrame([(1, "zeta alpha zeta alpha kernel the is ab beta")], "doc_id int, text string")
    got = [(r["rank"], r["token"], r["score"]) for r in vocab.keywords(vocab.tokens(df), 4).orderBy("rank").collect()]
    assert got == [(1, "kernel", 4.0), (2, "zeta", 2.0), (3, "alpha", 2.0), (4, "beta", 1.0)]
