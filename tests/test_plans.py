"""What the plans must not contain, whatever the data size."""

import __spark_entry__ as spark_entry
from paygrain.session import settings_for

def test_every_window_is_partitioned(spark, sf):
    for name in ("clean_transactions", "carried_topics", "top_bank_by_metric"):
        df = spark_entry.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows
        assert all("windowspecdefinition(" in line for line in windows)
        for line in windows:
            spec = line[line.index("windowspecdefinition(") + 21 :]
            assert not spec.split(",")[0].strip().endswith(("FIRST", "LAST"))


def test_settings_follow_the_data():
    small, large = settings_for(10), settings_for(100 * 2**40)
    assert small["spark.sql.shuffle.partitions"] == "1"
    assert large["spark.sql.shuffle.partitions"] == str(100 * 2**40 // 2**28)
    middle = settings_for(2**40)
    assert middle["spark.sql.shuffle.partitions"] == "4096"


# Which tables a snapshot query may read besides the lines.
NARROW = {
    "snapshot_overall": set(),
    "snapshot_months": set(),
    "snapshot_categories": set(),
    "month_series": set(),
    "overall_failures": set(),
    "category_failures": set(),
    "snapshot_banks": {"orders"},
    "bank_failures": {"orders"},
    "snapshot_merchants": {"supplier"},
    "busiest_merchants": {"supplier"},
}


def test_reports_read_no_table_that_they_do_not_need(spark, sf):
    for name, allowed in NARROW.items():
        df = spark_entry.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        read = {t for t in ("orders", "customer", "supplier") if f"{t[0]}_" + KEYS[t] in plan}
        assert read <= allowed, name


KEYS = {"orders": "orderkey", "customer": "custkey", "supplier": "suppkey"}
