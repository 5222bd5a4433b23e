import json

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import features, pairs
from sparkloom.plans import queries
from sparkloom.sources import dialog, sinks, synthetic, tables

LINES = """# head

du: hallo . bot: hi . bot: nochmal .
  du: du: wie geht du: es . bot: gut danke!
du: frage ? . bot: ja ?
du:  . bot: leer
du: nur so . bot:  .
du: ohne bot
sie: x . bot: y
du: ende... . bot: aus . . .
"""


def test_parser_edges(spark, tmp_path):
    path = tmp_path / "c.md"
    path.write_text(LINES)
    got = [(r["user"], r["bot"]) for r in dialog.read_dialog(spark, str(path)).orderBy("pos").collect()]
    assert got == [("hallo", "hi . bot: nochmal ."), ("wie geht  es", "gut danke! ."), ("frage ?", "ja ?"), ("ende", "aus .")]
    raw = [r["bot"] for r in dialog.read_dialog(spark, str(path), terminate=False).orderBy("pos").collect()]
    assert raw == ["hi . bot: nochmal", "gut danke!", "ja ?", "aus"]
    assert dialog.read_dialog(spark, str(tmp_path / "none.md"), optional=True).count() == 0


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a b", "c d ."), (1, "e", "f ?")], "pos long, user string, bot string")
    out = str(tmp_path / "out")
    sinks.write_dialog(rows, out, header="# corpus")
    assert [(r["user"], r["bot"]) for r in dialog.read_dialog(spark, out).orderBy("pos").collect()] == [("a b", "c d ."), ("e", "f ?")]
    sinks.write_marked(rows, str(tmp_path / "m"))
    assert "bot: f ?" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    toks = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "pos long, token string")
    sinks.write_token_text(toks, str(tmp_path / "t"), block=10)
    assert [r["token"] for r in dialog.read_tokens(spark, str(tmp_path / "t")).orderBy("pos").collect()][:3] == ["t0", "t1", "t2"]


def test_chunks_and_html_folder(spark, tmp_path):
    (tmp_path / "chunks.json").write_text(json.dumps([{"heading": "h", "text": "t", "keywords": ["a", "b c"]}]))
    both = spark.createDataFrame([("h2", 'a "q"', ["k"], None), ("h1", "b\nc", [], "s")], "heading string, text string, keywords array<string>, source string")
    sinks.write_chunks(both, str(tmp_path / "array"), array=True, order=("heading",))
    (part,) = (tmp_path / "array").glob("part-*")
    assert [c["heading"] for c in json.loads(part.read_text())] == ["h1", "h2"] and json.loads(part.read_text())[1]["source"] is None
    assert {tuple(r)[:2] for r in dialog.read_chunks(spark, str(tmp_path / "array")).collect()} == {("h1", "b\nc"), ("h2", 'a "q"')}
    sinks.write_chunks(both.limit(0), str(tmp_path / "empty"), array=True)
    assert dialog.read_chunks(spark, str(tmp_path / "empty")).count() == 0
    row = dialog.read_chunks(spark, str(tmp_path / "chunks.json")).first()
    assert row["keywords"] == ["a", "b c"] and row["lang"] is None
    (tmp_path / "en").mkdir()
    for name in ("one.html", "index.html", "en/two.html", "en/about.html"):
        (tmp_path / name).write_text(f"<p>{name}</p>")
    got = [(r["html"], r["page_lang"]) for r in dialog.read_html(spark, str(tmp_path)).collect()]
    assert got == [("<p>en/two.html</p>", "en"), ("<p>one.html</p>", "de")]
    assert dialog.read_html(spark, str(tmp_path / "nothing")).count() == 0


def test_keep_first_does_not_depend_on_partitions(spark):
    rows = [(i, i % 3, f"v{i}") for i in range(60)]
    for n in (1, 2, 7):
        df = spark.createDataFrame(rows, "pos long, k int, v string").repartition(n)
        assert sorted(tuple(r) for r in pairs.keep_first(df, ["k"], ["pos"]).collect()) == [(0, 0, "v0"), (1, 1, "v1"), (2, 2, "v2")]


def test_lines_follow_names_and_places(spark, tmp_path):
    (tmp_path / "c").mkdir()
    want = []
    for k, size in enumerate((3_000, 10, 40_000)):
        lines = [f"du: f{k} l{i} . bot: x ." for i in range(size)]
        (tmp_path / "c" / f"part{k}.md").write_text("\n".join(lines))
        want += [f"f{k} l{i}" for i in range(size)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = [r["user"] for r in dialog.read_dialog(spark, str(tmp_path / "c")).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_rag_pairs_and_written_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q2", "a."), (0, "q", "b")], "pos long, user string, bot string")
    sinks.write_rag_pairs(rows, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect() if r["value"]] == ["du: q . bot: b .", "du: q2 . bot: a. ."]
    tables.cut(rows, "x")
    assert tables.forget(spark) >= 1 and tables.forget(spark) == 0


def test_injection(spark, tmp_path):
    (tmp_path / "t.html").write_text("<p>old</p>\n<script>var M={};\nx\nvar gc=M.gc;\nvar M=2</script>")
    gone = sinks.inject_model(spark, str(tmp_path / "t.html"), str(tmp_path / "o"), {"a": [1, 2]}, {"old": "new", "none": "x"})
    (part,) = (tmp_path / "o").glob("part-*")
    assert gone == ["none"] and part.read_text().rstrip("\n") == '<p>new</p>\n<script>var M={"a":[1,2]}\nvar gc=M.gc;\nvar M=2</script>'


def test_slots(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("x",)], "a string"), spark.createDataFrame([("ja",), ("nein",)], "b string")
    got = sorted(tuple(r) for r in pairs.fill_slots([("mag {a} {b}", "{b} {a} {a}")], a=a, b=b).collect())
    assert got == [(x, y, 0, f"mag {x} {y}", f"{y} {x} {x}") for x in "xy" for y in ("ja", "nein")]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    assert all(r["x"] == r["n"] for r in dialog.numbered(df, "x", into="n").collect())


def test_literal_relations(spark):
    df = spark.createDataFrame([({"g": {"a": "1", "b": "2"}, "h": {"c": "3"}},)], "m map<string,map<string,string>>")
    assert sorted(tuple(r) for r in pairs.flatten_map(df, "m").collect()) == [("g", "a", "1"), ("g", "b", "2"), ("h", "c", "3")]


def test_packed_tensor_and_model(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((5, 7)).astype(np.float32)
    assert np.allclose(sinks.unpack_tensor(sinks.pack_tensor(x), (5, 7)), x, atol=2e-3)
    sinks.save_model(spark, str(tmp_path / "m"), {"context": 24}, {"vocab": spark.range(3)}, {"w": x})
    config, tables, tensors = sinks.load_model(spark, str(tmp_path / "m"))
    assert config == {"context": 24} and tables["vocab"].count() == 3 and tensors["w"].shape == (5, 7)


def test_html_files(spark, tmp_path):
    folder = f"file://{tmp_path}/site"
    pages = [("b.html", "<p>b</p>"), ("en/a.html", "<p>ä</p>"), ("index.html", "no"), ("en/404.html", "no"), ("c.html", None), ("deep/er/x.html", "not read")]
    assert dialog.write_html(spark.createDataFrame(pages, "name string, html string"), folder) == 6
    got = [(r["pos"], r["url"].split("/site/")[1], r["html"], r["page_lang"]) for r in dialog.read_html(spark, folder).orderBy("pos").collect()]
    assert [(p, u, l) for p, u, _, l in got] == [(0, "b.html", "de"), (1, "en/a.html", "en")]
    assert got[0][2] == "<p>b</p>" and got[1][2] == "<p>ä</p>"
    assert dialog.read_html(spark, f"file://{tmp_path}/none").count() == 0


def test_synthetic_problem_does_not_depend_on_partitions(spark):
    spark.dataSource.register(synthetic.SyntheticProblem)
    read = lambda n, rows=700: spark.read.format("loom_problem").option("rows", rows).option("features", 6).option("targets", 4).option("partitions", n).load()
    want = None
    for n in (1, 4, 13):
        rows = read(n)
        assert rows.count() == 700 and rows.rdd.getNumPartitions() == n
        cells = {(r["kind"], r["i"], r["j"]): r["value"] for r in features.cells(features.gram(rows)).collect()}
        want = want or cells
        assert cells.keys() == want.keys() and all(abs(cells[k] - want[k]) < 1e-9 for k in want)
    x, t = synthetic.row_of(699, 6, 4, 42)
    assert any(r["target_id"] == t and np.allclose(r["x"], x) for r in read(2).collect())
    assert abs(np.std([r["x"] for r in read(2, 5_000).collect()]) - 0.1) < 0.003 and read(3, 0).count() == 0


def test_regular_expressions_run_after_the_exchange(spark, sf_dir):
    """The scan's few tasks only read: what is computed stands above the exchange."""
    for name in ("section_pairs", "html_sections", "article_tokens", "rag_chunks"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Repartition") :]
        assert "regexp" not in below.lower() and "regexp" in plan.lower()
