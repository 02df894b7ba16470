"""Every registered query against its SQL, and what the plans may not contain."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks import oracle, registry
from checks.compare import compare, database

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_imports_without_the_training_data_folder(tmp_path):
    """The same queries are there when that folder and the pipeline are not."""
    root = Path(entry.__file__).parent
    for name in ("stationflow", "checks"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    asks = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for pipeline in (False, True):
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        told = subprocess.run([sys.executable, "-c", asks], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert told.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


# A window over a whole table is fine only where the table is one row per day, or a pool or grid of known size.
SMALL_WINDOWS = {"gap_summary", "data_gaps", "data_health", "data_health_recent"}
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas")


def check_plan(name, df):
    execution = df._jdf.queryExecution()
    physical, logical = execution.executedPlan().toString(), execution.optimizedPlan().toString()
    if not name.startswith(("stream_", "ingest_")):
        for banned in BANNED:
            assert banned not in physical, f"{banned} in {name}"
    for line in logical.splitlines():
        if re.search(r"\bWindow \[", line) and name not in SMALL_WINDOWS:
            keys = re.findall(r"windowspecdefinition\(([^,)]*)", line)
            # the second level of running sums over a grid: one row per bin of 4,096 ticks
            keys = [k for k in keys if not k.startswith("_bin#")]
            assert all(" ASC" not in k and " DESC" not in k for k in keys), f"{name}: {line[:300]}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    check_plan(name, df)
    problems = [p for p in compare(con, df, SQL[name]) if p != "no rows"]
    assert not problems
