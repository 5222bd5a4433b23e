"""A synthetic solver problem as a Spark data source.

Rows come from a counter-based generator that jumps to any row, so they don't depend on
partitions, and a lost partition is made again alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of one Arrow batch.
BATCH = 512
# The benchmark's scale of features.
SCALE = 0.1


def row_of(row: int, features: int, targets: int, seed: int) -> tuple[np.ndarray, int]:
    """Features and label of one row: its own stream of the generator."""
    rng = np.random.Generator(np.random.Philox(key=seed, counter=[0, row, 0, 0]))
    return rng.standard_normal(features) * SCALE, int(rng.integers(0, targets))


class Span(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class ProblemReader(DataSourceReader):
    def __init__(self, options: dict):
        number = lambda name, default: int(options.get(name, default))
        self.features, self.targets, self.seed = number("features", 64), number("targets", 1000), number("seed", 42)
        self.rows = number("rows", max(2 * self.features, 5_000))
        self.parts = max(number("partitions", max(self.rows * self.features // 4_000_000, 1)), 1)
        if min(self.features, self.targets) < 1 or self.rows < 0:
            raise ValueError("features and targets have to be 1 at least, rows 0")

    def partitions(self) -> list[Span]:
        cut = [self.rows * k // self.parts for k in range(self.parts + 1)]
        return [Span(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.end, BATCH):
            made = [row_of(r, self.features, self.targets, self.seed) for r in range(at, min(at + BATCH, partition.end))]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x, _ in made], pa.list_(pa.float64())), pa.array([t for _, t in made], pa.int32())], ["x", "target_id"])


class SyntheticProblem(DataSource):
    """``format("loom_problem")``: rows x (Gaussian features times 0.1) and target_id (random
    label), with options rows, features, targets, seed and partitions."""

    @classmethod
    def name(cls) -> str:
        return "loom_problem"

    def schema(self) -> str:
        return "x array<double>, target_id int"

    def reader(self, schema) -> ProblemReader:
        return ProblemReader(self.options)
