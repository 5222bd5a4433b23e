import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import common
from tests.llm.test_scans import all_spans
from tests.llm.test_simhash import copy_roots

#: An id of the fold that language ID doesn't learn from.
HELD_OUT = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)


def test_stages(spark, docs, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "secrets", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = common.cut(stage(spark, before, sf_dir), "stage")
        assert kept.columns == docs.columns, name
        a, b = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in kept.collect()}
        assert set(b) <= set(a) and len(b) == kept.count()
        if name == "language":
            assert set(a) - set(b) == {i for i, r in a.items() if not any(c.isalpha() for c in r["text"] or "")}
        if name == "near_duplicates":
            ids = sorted(a)  # texts of a Jaccard similarity of 0.8 or more over five words, all pairs
            least = {}
            for i, group in zip(ids, copy_roots([a[i]["text"] for i in ids])):
                least.setdefault(group, i)
            assert set(b) == set(least.values())
        if name == "secrets":
            assert set(a) == set(b)
            for i, r in b.items():
                assert r["n_chars"] == len(r["text"]) and (r["text"] == a[i]["text"]) == (not all_spans(a[i]["text"]))
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r["doc_id"] for r in kept.collect()}) <= 0.5 * len(toxic)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_odd_rows_pass_the_stages(spark, odd, sf_dir):
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.cut(stage(spark, kept, sf_dir), "stage")
        assert kept.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).count() >= kept.count() > 0


def test_language_stage_without_a_learned_language(spark, odd, sf_dir):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    held_out = odd.where("doc_id = 9").withColumn("doc_id", F.lit(HELD_OUT).cast("long"))
    for rows, want in ((unlabelled, [-1, 4, 5, 5, 6, 8, 9]), (held_out, [HELD_OUT])):
        kept = corpus_pipeline.drop_no_language(spark, rows, sf_dir).collect()
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == want
        assert {r["lang"] for r in kept} == {r["lang"] for r in rows.collect()}


def test_stages_keep_columns_of_any_name(spark, odd, sf_dir):
    taken = odd.withColumn("spans", F.lit("x")).withColumn("base", F.lit("y")).withColumn("toxicity", F.lit(1)).withColumn("found_lang", F.lit("z")).withColumn("__text", F.lit("q")).withColumn("place", F.lit(0)).withColumn("c0", F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, taken, sf_dir)
        assert kept.columns == taken.columns, name
        assert {(r["spans"], r["base"], r["toxicity"], r["found_lang"], r["__text"], r["c0"]) for r in kept.collect()} == {("x", "y", 1, "z", "q", 7)}


def test_stages_of_an_empty_table(spark, none, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
