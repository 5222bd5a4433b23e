"""Keyed session state over a stream of conversation turns, and incremental sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, turn long, text string, last_bot string, combined string"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # no turn for long: the conversation is over
        state.remove()
        return
    # one micro-batch's turns of one conversation; maxFilesPerTrigger bounds them
    rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
    last = state.get[0] if state.exists else ""
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    out = []
    for turn, role, text in rows[["turn", "role", "text"]].itertuples(index=False):
        if role == "user":
            out.append((key[0], turn, text, last, f"{last} {text}".strip()))
        elif role == "assistant":
            last = text
    state.update((last,))
    if out:
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "last_bot", "combined"])


def last_bot_stream(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """User turns of a stream with the assistant's last text of their conversation.

    State is one string per conversation; with ``idle_ms`` it goes that long after its last
    turn, which needs a trigger that goes on (one that ends with the input waits for it). Turns are taken in order within a micro-batch;
    a turn that arrives in a later batch than its successor sees what came before it.
    """
    keyed = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return keyed.groupBy("conv_id").applyInPandasWithState(partial(_carry, idle_ms=idle_ms), OUT, "last string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def running_counts(tokens: DataFrame, time: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Token counts per window of event time, late rows within the watermark included."""
    return tokens.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), "token").agg(F.count("*").alias("n"))


def accumulate_gram(stream: DataFrame, folder: str, checkpoint: str, gram) -> object:
    """Gram sums of each micro-batch as Parquet under ``folder``, one folder a batch, so
    a repeated batch overwrites its own; their sum is the sum of all."""

    def write(batch: DataFrame, number: int) -> None:
        gram(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
