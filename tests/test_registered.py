"""Every registered query against its SQL on the smallest tables, and rules for all plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# The training-data queries have tests of their own.
QUERIES = {k: v for k, v in entry.queries().items() if not (k.startswith("op") or k == "pipeline")}
ORACLES = {k: v for k, v in ORACLES.items() if k in QUERIES}

# Windows over a table with one row per file block: line numbers and row numbers.
ONE_TASK = {"s04_read_line_labels", "s05_read_keyed_captions", "p03_assign_id"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# Held against brute force in their own tests.
NO_SQL = {"m02b_align_by_cost"}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) | NO_SQL


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_binds(duck, name):
    """Before any Spark run: every text names only what is there."""
    duck.execute(f"EXPLAIN {ORACLES[name]}").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())

    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in plan
    if name not in ONE_TASK:
        before_window = [a for a, b in zip(plan.splitlines(), plan.splitlines()[1:]) if "Exchange SinglePartition" in b]
        assert not any("Window" in line or "Sort" in line for line in before_window)
