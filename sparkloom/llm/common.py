"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import cut, fresh_path, shared_dir

__all__ = ["bound_batches", "bounded", "bounded_session", "crc32_of_id", "cut", "documents", "free_name", "fresh_path", "shared_dir", "shuffle_parts", "table", "tokenizer_path"]


#: Bytes of an Arrow batch on its way to a Python worker, rows of a columnar batch, and bytes
#: of a row group that a task holds as it writes and as it reads it again.
BATCH_BYTES, BATCH_ROWS, GROUP_BYTES = 4_000_000, 512, 16_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches of a session that texts travel in: Arrow's by bytes, as rows alone don't bound
    them where texts are long, and Parquet's to few rows, so that no executor makes arrays
    of many MB for a column of texts; tables are written in small row groups. Smaller bounds that the session has stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key, "4096")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "parquet.block.size"
    if int(spark.conf.get(key, "134217728")) > GROUP_BYTES:
        spark.conf.set(key, str(GROUP_BYTES))


def bounded_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, with its settings but bounded batches. ``spark`` keeps
    its own, and so does what is read and run in it."""
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    bound_batches(beside)
    return beside


def bounded(df: DataFrame) -> DataFrame:
    """``df`` for a plan that runs in bounded batches (:func:`bounded_session`), its own
    table's scan aside. Column names have to differ."""
    name, spark = f"loom_{uuid.uuid4().hex}", df.sparkSession
    df.createGlobalTempView(name)
    try:
        return bounded_session(spark).table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read in bounded batches."""
    return bounded_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return table(spark, sf_dir, "documents")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or as many underscores before it as no column of ``taken`` has."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
