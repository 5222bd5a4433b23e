"""Readers: dialog corpora, token files, chunk lists and HTML folders."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkloom.functions import text as tx
from sparkloom.sources import tables

CHUNK = T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType())])
PAIR = "pair_id long, user string, bot string"
# Pages that are no content.
SKIP_PAGES = ["404", "datenschutz", "impressum", "imprint", "privacy", "index", "sitemap", "about"]
# The corpus line format.
USER_MARK, BOT_MARK = "du:", " bot: "


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file or of the files of a folder: lines in the order of their
    files' names and their places there, numbered from 0, however the files are split."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return numbered(rows, "file", "block", "at", into="pos").select("pos", "line")


def parse_dialog(lines: DataFrame, terminate: bool = True) -> DataFrame:
    """(pos, user, bot) of the lines ``du: <user> . bot: <bot> .``.

    Other lines are skipped, as are pairs with an empty side. Trailing spaces and stops
    go; with ``terminate`` a bot side whose last token isn't . ? or ! gets `` .``. Null
    lines are skipped; repeated lines are kept; an empty table gives no rows.
    """
    line = F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    rows = lines.select("pos", line.alias("l")).where(F.col("l").startswith(USER_MARK) & F.col("l").contains(BOT_MARK))
    at = F.instr("l", BOT_MARK)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    user = tx.right_strip(strip(F.replace(F.substring("l", F.lit(1), at - 1), F.lit(USER_MARK), F.lit(""))), " .")
    bot = tx.right_strip(strip(F.substring("l", at + len(BOT_MARK), F.length("l"))), " .")
    rows = rows.select("pos", user.alias("user"), bot.alias("bot")).where("user != '' and bot != ''")
    if not terminate:
        return rows
    last = F.element_at(tx.words(F.col("bot"), r"(?U)\s+"), -1)
    return rows.withColumn("bot", F.when(last.isin(".", "?", "!"), F.col("bot")).otherwise(F.concat("bot", F.lit(" ."))))


def read_dialog(spark: SparkSession, path: str, terminate: bool = True, optional: bool = False) -> DataFrame:
    """Dialog corpus of a file; a missing ``optional`` one is empty."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], "pos long, user string, bot string")
    return parse_dialog(text_lines(spark, path), terminate)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token) of a file's white-space separated tokens, line by line, so a file of
    any size is read in parallel."""
    lines = text_lines(spark, path).select(F.col("pos").alias("l"), F.posexplode(tx.words(F.col("line"), r"(?U)\s+")).alias("i", "token"))
    return numbered(lines, "l", "i", into="pos").select("pos", "token")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk list: a JSON array of objects; absent fields are null."""
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def content_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose base name isn't one of the service pages; with the language tag."""
    name = F.regexp_extract(url, r"([^/]+?)(?:\.html)?/?$", 1)
    return pages.where(~name.isin(SKIP_PAGES)).withColumn("page_lang", tx.language_of_path(F.col(url)))


def write_html(pages: DataFrame, folder: str, name: str = "name", html: str = "html") -> int:
    """Write each page as a file of its own: ``name`` is its path below the folder. Tasks write
    under another name first, so a retried task leaves no half page. Null pages are empty;
    returns the number of files."""

    def run(batches):
        for batch in batches:
            for at, text in zip(batch.column("name").to_pylist(), batch.column("html").to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(f"{folder}/{at}")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                attempt = f"{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(attempt, compression=None) as out:
                    out.write(text.encode())
                fs.move(attempt, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = pages.select(F.col(name).alias("name"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, url, html, page_lang) of ``*.html`` and ``en/*.html`` of a folder, service pages
    left out; pos numbers them in the order of their paths. One pass over the files, many
    small ones a task; only paths are ordered, not pages. Empty files give no row."""
    paths = []
    for p in (f"{folder}/*.html", f"{folder}/en/*.html"):
        found = spark._jvm.org.apache.hadoop.fs.Path(p)
        if found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found):
            paths.append(p)
    if not paths:
        return spark.createDataFrame([], "pos long, url string, html string, page_lang string")
    rows = content_pages(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))
    places = numbered(rows.select("url"), "url", into="pos")
    return rows.join(places, "url").select("pos", "url", "html", "page_lang")


def numbered(rows: DataFrame, *order, into: str = "pair_id") -> DataFrame:
    """``rows`` with consecutive numbers in the order given, without one global sort task:
    rows are range-partitioned, sorted and written with their places in their partitions, as
    sampling might cut the ranges elsewhere when they are made twice. The sizes of the
    partitions before are added to the places; there are as many sizes as shuffle partitions,
    so they are sent to every task."""
    place = F.monotonically_increasing_id()  # of a task: its number, and the row's place from 0
    kept = tables.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "numbered")
    part = F.shiftright("__at", 33).alias("__p")
    sizes = kept.groupBy(part).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(into, (F.col("__b") + own).cast("long")).drop("__p", "__at", "__b")
