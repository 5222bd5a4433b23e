"""Tables written in between, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []
#: Temporary folders of applications that have set none.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on one machine (tests) a temporary folder
    is made, one for the application; a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = tempfile.mkdtemp(prefix="loom-shared-")
        atexit.register(shutil.rmtree, _MADE[app], True)
    return f"file://{_MADE[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if its files give fewer partitions; larger tables stay.
    The filter lets all rows pass; later filters, and what they compute, aren't moved below
    it into the few tasks of the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores).where(F.spark_partition_id() >= 0) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read of the table, not a recomputation,
    and all readers see the same rows in the same partitions. The table stays until
    :func:`forget`.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut` has written for this driver so far, once no frame
    that reads them is needed; returns their number."""
    done = 0
    while _WRITTEN:
        done += drop(spark, _WRITTEN.pop())
    return done


def drop(spark: SparkSession, path: str) -> bool:
    """Delete one folder that no frame reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
