"""Every registered query against its SQL, on the smallest data."""

import importlib.util
import os

import pytest

from veilspark.plans.oracle import oracle
from veilspark.plans.queries import registry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

spec = importlib.util.spec_from_file_location("entry_points", f"{ROOT}/__spark_entry__.py")
entry_points = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_points)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in sorted(os.listdir(DATA)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{file}'")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_sql():
    assert set(registry()) == set(oracle())
    assert set(registry()) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, database, name):
    df = entry_points.queries()[name](spark, DATA)
    cursor = database.execute(entry_points.oracle_sql()[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """Masking moves no text; the tagger of a stored entity runs once."""
    found = registry()
    assert "Exchange" not in plan(found["mask_spans_documents"](spark, DATA))
    assert plan(found["without_overlaps_letters"](spark, DATA)).count("ArrowEvalPython") == 1


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
