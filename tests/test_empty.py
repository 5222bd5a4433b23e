"""Every registered query over empty tables, and small contracts of the entry module."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.oracle import TABLES

#: Queries whose rows don't come from a table.
MADE = {"arith_pairs", "arith_validation", "position_weights", "ridge_filter", "solver_benchmark", "benchmark_file", "literal_pairs"}
#: Aggregates without a key have a row over nothing; so do their cousins; greetings have their own.
ONE_ROW = {"corpus_stats", "relative_error", "top1_accuracy", "pass_verdict", "category_rollup", "label_rollup", "greeting_shortcut"}


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_over_empty_tables(spark, empty_dir, name):
    rows = entry.queries()[name](spark, empty_dir).collect()
    assert name in MADE | ONE_ROW or rows == []


def test_a_missing_library_is_not_hidden():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.HERE)
    assert done.returncode and "xxhash" in done.stderr or entry.llm is None
