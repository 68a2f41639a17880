import duckdb
import pytest

import __spark_entry__ as spark_entry
from checks.oracles import ORACLES
from paygrain.sources import orders_feed as feed
from tools.compare import TABLES, table


# What no plan may contain, whatever the data size.
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroups",
    "PythonUDF",
)


def test_every_statement_belongs_to_a_query():
    assert set(ORACLES) <= set(spark_entry.queries())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert "failure_rate_pct" in df.columns
    assert df.count() > 0


@pytest.fixture(scope="module")
def database(sf):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(spark_entry._reference_queries()))
def test_query_agrees_with_its_statement(spark, sf, database, name):
    df = spark_entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    mine = df.collect()
    if name not in ORACLES:
        assert mine
        return
    result = database.execute(ORACLES[name])
    names = [item[0] for item in result.description]
    assert sorted(df.columns) == sorted(names)
    assert table(mine, df.columns) == table(result.fetchall(), names)


def test_reports_read_only_what_they_need(spark, sf):
    df = spark_entry.queries()["status_distribution"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "orders" not in plan and "supplier" not in plan
    assert "l_discount" not in plan and "l_tax" not in plan


def test_leaving_a_lookup_out_changes_no_row(spark, sf):
    bare = feed.transactions(spark, sf)
    full = feed.full_transactions(spark, sf).select(*bare.columns)
    assert bare.exceptAll(full).count() == 0 and full.exceptAll(bare).count() == 0
