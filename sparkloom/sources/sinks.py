"""Writers: dialog corpora, chunk lists, token files, packed tensors, reports, models."""

from __future__ import annotations

import base64
import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import tiles
from sparkloom.sources.dialog import text_lines


def dialog_line(user: Column, bot: Column) -> Column:
    return F.concat(F.lit("du: "), user, F.lit(" . bot: "), tx.right_strip(bot, " ."), F.lit(" ."))


def write_dialog(pairs: DataFrame, path: str, order: str = "pos", header: str | None = None) -> None:
    """One pair a line, blank lines between; an optional first line. The order of lines
    is part of the format, so this writes one file."""
    lines = pairs.select(F.col(order).alias("o"), F.concat(dialog_line(F.col("user"), F.col("bot")), F.lit("\n")).alias("value"))
    if header is not None:
        lines = lines.union(lines.sparkSession.createDataFrame([(-1, header + "\n")], "o long, value string"))
    lines.repartition(1).sortWithinPartitions("o").select("value").write.text(path)


def write_marked(pairs: DataFrame, path: str, order: str = "pos") -> None:
    """As :func:`write_dialog`, but a side that ends in . ? or ! keeps its ending."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bot = strip(F.col("bot"))
    ended = F.when(bot.rlike(r"[.?!]$"), bot).otherwise(F.concat(bot, F.lit(" .")))
    line = F.concat(F.lit("du: "), strip(F.col("user")), F.lit(" . bot: "), ended, F.lit("\n"))
    pairs.repartition(1).sortWithinPartitions(order).select(line.alias("value")).write.text(path)


def write_chunks(chunks: DataFrame, path: str, array: bool = False, order: tuple[str, ...] = ()) -> None:
    """Chunks as JSON lines, one file a partition; or as one file that holds one array of
    objects, in the order given. That file is written line by line, not from one row."""
    if not array:
        chunks.write.json(path)
        return
    write_json_array(chunks, path, order)


def write_json_array(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """One JSON array in one file, an object a line. The format asks for one file; lines are
    made in parallel and one task writes them in order. Null fields stay null."""
    by = [F.col(c) for c in order]
    keys = [c.alias(f"__o{k}") for k, c in enumerate(by)]
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"), *keys)
    spark, n = rows.sparkSession, len(keys)
    last = spark.createDataFrame([("[", 0), ("]", 2)], "value string, __part int")
    body = lines.withColumn("__part", F.lit(1))
    both = body.unionByName(last, allowMissingColumns=True)
    spread = both.repartition(1).sortWithinPartitions("__part", *[f"__o{k}" for k in range(n)])
    # numbers of the one sorted partition's lines: the first object's is 1
    spread = spread.withColumn("__at", F.monotonically_increasing_id())
    comma = F.when((F.col("__at") > 1) & (F.col("__part") == 1), F.lit(",")).otherwise(F.lit(""))
    spread.select(F.concat(comma, "value").alias("value")).write.text(path)


def write_report(results: DataFrame, path: str, order: tuple[str, ...] = ("scenario_id",)) -> None:
    """Test results as one JSON array, in order."""
    write_json_array(results, path, order)


def write_benchmark(results: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Benchmark rows as one JSON array, in order."""
    write_json_array(results, path, order)


# The marks between which a page has its model.
def inject_model(spark: SparkSession, template: str, path: str, model: dict, swaps: dict[str, str] | None = None, start: str = "var M=", stop: str = "\nvar gc=M.gc") -> list[str]:
    """Write the page of a template file with the model's compact JSON between the two
    marks, and with ``swaps`` made; returns the texts to swap that it doesn't hold. The
    page is one text and so is the file."""
    page = spark.read.text(template, wholetext=True)
    missing = [old for old in swaps or {} if not page.where(F.col("value").contains(old)).limit(1).count()]
    text = tx.put_between(F.col("value"), start, stop, F.lit(start + json.dumps(model, separators=(",", ":"))))
    for old, new in (swaps or {}).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    page.select(text.alias("value")).coalesce(1).write.text(path)
    return missing


def write_rag_pairs(pairs: DataFrame, path: str, order: str = "pos") -> None:
    """Questions and answers as they are, a pair and a blank line each: no stops are taken
    off or added but the closing ones."""
    line = F.concat(F.lit("du: "), F.col("user"), F.lit(" . bot: "), F.col("bot"), F.lit(" .\n"))
    pairs.repartition(1).sortWithinPartitions(order).select(line.alias("value")).write.text(path)


def write_token_text(tokens: DataFrame, path: str, order: str = "pos", block: int = 1_000) -> None:
    """Tokens joined by spaces, ``block`` a line, in order."""
    at = F.floor(F.col(order) / block).alias("b")
    rows = tokens.groupBy(at).agg(F.array_sort(F.collect_list(F.struct(order, "token"))).alias("x"))
    line = F.array_join(F.transform("x", lambda t: t["token"]), " ")
    rows.repartition(1).sortWithinPartitions("b").select(line.alias("value")).write.text(path)


def pack_tensor(array: np.ndarray) -> str:
    """Half precision, row-major, gzip, base64."""
    half = np.ascontiguousarray(array, dtype=np.float16)
    return base64.b64encode(gzip.compress(half.tobytes(), 9, mtime=0)).decode("ascii")


def unpack_tensor(text: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(gzip.decompress(base64.b64decode(text)), np.float16).reshape(shape).astype(np.float32)


def _member(data: bytes) -> bytes:
    """One gzip member of a length that base64 cuts evenly: the header's extra field has as
    many bytes as that takes."""
    press = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = -(12 + len(body)) % 3
    # The format's magic, method, flag of an extra field, no time, best, unknown system.
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x02\xff" + struct.pack("<H", extra) + bytes(extra) + body


def write_tensor(tiled: DataFrame, grid: tiles.Grid, path: str) -> None:
    """A matrix of tiles as text: half precision, row-major, gzip, base64. Each band of rows
    is a gzip member and a line of its own; the lines joined are one stream that any reader
    takes. Bands are made in parallel, in order by file and line; tiles that aren't there are
    0. A task holds one band."""

    def run(batches):
        band, key = None, None

        def line():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([base64.b64encode(_member(band.astype(np.float16).tobytes())).decode("ascii")])], ["i", "value"])

        for batch in batches:
            for i, j, cells in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "cells")), strict=True):
                if i != key:
                    if key is not None:
                        yield line()
                    key, band = i, np.zeros((grid.height(i), grid.columns))
                if cells is not None:
                    band[:, j * grid.wide : j * grid.wide + grid.width(j)] = np.frombuffer(cells, np.float64).reshape(-1, grid.width(j))
        if key is not None:
            yield line()

    every = tiled.sparkSession.range(grid.down).select(F.col("id").cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(None).cast("binary").alias("cells"))
    rows = tiled.select("i", "j", "cells").union(every).repartitionByRange("i").sortWithinPartitions("i", "j")
    rows.mapInArrow(run, "i int, value string").select("value").write.text(path)


def read_tensor(spark: SparkSession, path: str, grid: tiles.Grid) -> DataFrame:
    """(i, j, value) of the cells of a written matrix; lines are read in parallel."""
    lines = text_lines(spark, path)

    def run(batches):
        for batch in batches:
            for pos, line in zip(batch.column("pos").to_pylist(), batch.column("line").to_pylist(), strict=True):
                band = np.frombuffer(gzip.decompress(base64.b64decode(line)), np.float16).reshape(-1, grid.columns)
                for at in range(0, len(band), 64):
                    block = band[at : at + 64]
                    y, x = np.divmod(np.arange(block.size), grid.columns)
                    yield pa.RecordBatch.from_arrays([pa.array((y + at + pos * grid.tall).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(block.ravel().astype(np.float64))], ["i", "j", "value"])

    return lines.mapInArrow(run, "i int, j int, value double")


def save_model(spark: SparkSession, path: str, config: dict, tables: dict[str, DataFrame], tensors: dict[str, np.ndarray]) -> None:
    """A model as Parquet tables, packed tensors with their shapes, and a JSON config."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(n, json.dumps(list(t.shape)), pack_tensor(t)) for n, t in tensors.items()]
    spark.createDataFrame(rows, "name string, shape string, data string").coalesce(1).write.mode("overwrite").parquet(f"{path}/__tensors")
    meta = {"config": config, "tables": sorted(tables)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/__meta")


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame], dict[str, np.ndarray]]:
    meta = json.loads(spark.read.text(f"{path}/__meta").first()["value"])
    tensors = {r["name"]: unpack_tensor(r["data"], tuple(json.loads(r["shape"]))) for r in spark.read.parquet(f"{path}/__tensors").collect()}
    return meta["config"], {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}, tensors
