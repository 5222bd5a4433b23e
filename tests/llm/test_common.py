from sparkloom.llm import common

KEYS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.shuffle.partitions")


def test_sessions_keep_their_settings(spark, sf_dir):
    before = {k: spark.conf.get(k, None) for k in KEYS}
    docs = common.documents(spark, sf_dir)
    inside = docs.sparkSession.conf
    assert inside.get(KEYS[0]) == str(common.BATCH_BYTES) and inside.get(KEYS[1]) == str(common.BATCH_ROWS) and inside.get(KEYS[2]) == before[KEYS[2]]
    moved = common.bounded(spark.range(5).withColumnRenamed("id", "doc_id"))
    assert moved.sparkSession.conf.get(KEYS[0]) == str(common.BATCH_BYTES)
    assert sorted(r["doc_id"] for r in moved.collect()) == list(range(5)) and moved.join(docs, "doc_id").count() == docs.where("doc_id < 5").count()
    assert {k: spark.conf.get(k, None) for k in KEYS} == before
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("loom_")]


def test_smaller_bounds_stay(spark, sf_dir):
    beside = spark.newSession()
    beside.conf.set(KEYS[0], "1m")
    beside.conf.set(KEYS[1], "100")
    inside = common.documents(beside, sf_dir).sparkSession.conf
    assert inside.get(KEYS[0]) == "1m" and inside.get(KEYS[1]) == "100"
