import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paygrain import model
from paygrain.operators import cleaning, filters, rankings
from paygrain.plans import snapshot
from tests.conftest import rows
from tests.fixtures import served_row, snapshot_source


@pytest.fixture(scope="module")
def source(spark):
    return cleaning.snapshot_rows(snapshot_source(spark))


def test_overall(source):
    assert snapshot.overall(source).first().asDict() == {
        "total_transactions": 3,
        "completed_transactions": 2,
        "completed_amount": 175.0,
        "success_rate": 2 / 3,
        "currency": "INR",
        "failed_transactions": 1,
    }


def test_no_private_column_enters_the_snapshot(spark):
    source = snapshot_source(spark)
    assert set(filters.safe_rows(source).columns) == set(model.SAFE_COLUMNS)
    with pytest.raises(ValueError, match="currency"):
        cleaning.snapshot_rows(source.drop("currency"))


def test_groups(source):
    bank = snapshot.banks(source).where("bank = 'Example Bank'").first()
    assert (bank.transaction_count, bank.completed_transactions, bank.success_rate) == (2, 1, 0.5)
    shop = snapshot.merchants(source).where("merchant = 'Shop One'").first()
    assert (shop.transaction_count, shop.failure_rate, shop.completed_amount) == (2, 0.5, 100.0)
    months = [r["month"] for r in rows(snapshot.months(source))]
    assert months == ["2026-01", "2026-02"]


def test_merchants_of_one_name_are_one_entry(spark):
    extra = served_row(9, "C1", "M9", "Shop One", "Retail", 1, "Failed", "B", "Debit")
    tx = snapshot_source(spark)
    tx = tx.unionByName(spark.createDataFrame([extra], tx.schema))
    shop = snapshot.merchants(cleaning.snapshot_rows(tx)).where("merchant = 'Shop One'")
    assert [r.transaction_count for r in shop.collect()] == [3]


def test_null_bank_is_a_group(spark):
    tx = snapshot_source(spark).withColumn("bank_name", F.lit(None).cast("string"))
    assert snapshot.banks(cleaning.snapshot_rows(tx)).count() == 1


def test_top_entities(source):
    banks = {r.metric: r.bank for r in rankings.top_banks(snapshot.banks(source)).collect()}
    assert banks["transaction_count"] == "Example Bank"
    assert banks["success_rate"] == "Other Bank"
    shops = {r.metric: r.merchant for r in rankings.top_merchants(snapshot.merchants(source)).collect()}
    assert shops["transaction_count"] == "Shop One"
    assert shops["failure_rate"] == "Shop One"
    cats = {r.metric: r.category for r in rankings.top_categories(snapshot.categories(source)).collect()}
    assert cats["transaction_count"] == "Retail"


def test_all_grains_agree_with_each_grain(source):
    grains = {}
    for row in snapshot.all_grains(source).collect():
        grains.setdefault(row.grain, {})[row.name, row.category] = row
    assert {name: len(found) for name, found in grains.items()} == {
        "overall": 1, "bank": 2, "merchant": 2, "category": 2, "month": 2
    }
    overall = grains["overall"][None, None]
    assert (overall.transaction_count, overall.completed_amount) == (3, 175.0)
    for row in snapshot.merchants(source).collect():
        same = grains["merchant"][row.merchant, row.category]
        assert same.failure_rate == row.failure_rate and same.success_rate is None
    for row in snapshot.banks(source).collect():
        same = grains["bank"][row.bank, None]
        assert same.success_rate == row.success_rate and same.failure_rate is None


def test_ties_take_count_then_the_larger_name(spark):
    schema = (
        "bank string, transaction_count long, completed_amount double, "
        "completed_transactions long, success_rate double, failed_transactions long"
    )
    banks = spark.createDataFrame(
        [("A", 9, 5.0, 2, 0.5, 1), ("B", 4, 5.0, 2, 0.5, 1), ("C", 4, 5.0, 2, 0.5, 0)], schema
    )
    got = {r.metric: r.bank for r in rankings.top_banks(banks).collect()}
    assert got == {
        "transaction_count": "A",
        "completed_amount": "A",
        "completed_transactions": "A",
        "success_rate": "A",
        "failed_transactions": "B",
    }


def test_busiest_ties_keep_name_order(spark):
    shops = spark.createDataFrame(
        [("B", "y", 3), ("A", "z", 3), ("A", "x", 3), ("C", "x", 9)],
        "merchant string, category string, transaction_count long",
    )
    got = [(r.merchant, r.category) for r in rankings.busiest_merchants(shops, 3).collect()]
    assert got == [("C", "x"), ("A", "x"), ("A", "z")]


def test_comparison_and_failures(source):
    banks = rows(rankings.compare(snapshot.banks(source), "bank"))
    assert [(r["bank"], r["failure_rate"], r["currency"]) for r in banks] == [
        ("Example Bank", 0.5, "INR"),
        ("Other Bank", 0.0, "INR"),
    ]
    shops = rows(rankings.failures(snapshot.merchants(source), "merchant"))
    assert [(r["failed_transactions"], r["transaction_count"]) for r in shops] == [(1, 2), (0, 1)]
    cats = rows(rankings.failures(snapshot.categories(source), "category", ["RETAIL"]))
    assert [(r["category"], r["failed_transactions"], r["transaction_count"]) for r in cats] == [
        ("Retail", 1, 2)
    ]
    overall = rankings.overall_failures(snapshot.overall(source)).first()
    assert (overall.failed_transactions, overall.total_transactions) == (1, 3)


def test_comparison_takes_the_prevailing_currency(spark):
    tx = snapshot_source(spark).withColumn(
        "currency", F.when(F.col("transaction_month") == "2026-02", "INR").otherwise("USD")
    )
    rows_ = cleaning.snapshot_rows(tx)
    banks = rankings.compare(snapshot.banks(rows_), "bank", currency=snapshot.currency(rows_))
    assert {r.currency for r in banks.collect()} == {"USD"}
    assert snapshot.overall(rows_).first().currency == "USD"


def test_unmeasured_metrics_stay_null(spark):
    banks = spark.createDataFrame(
        [("A", 2, None), ("B", 3, 1)],
        "bank string, transaction_count long, failed_transactions long",
    )
    compared = {r.bank: r.failure_rate for r in rankings.compare(banks, "bank").collect()}
    assert compared["A"] is None and compared["B"] == pytest.approx(1 / 3)
    known = {r.metric: r.available for r in rankings.availability(banks, ["transaction_count", "failed_transactions"]).collect()}
    assert known == {"transaction_count": True, "failed_transactions": False}
    unknown = spark.createDataFrame([(None, 3)], "failed_transactions long, total_transactions long")
    assert rankings.overall_failures(unknown).first().failure_rate is None


def test_series(source):
    months = snapshot.months(source)
    assert rankings.month_series(months).columns == [
        "month",
        "transaction_count",
        "completed_transactions",
        "failed_transactions",
    ]
    assert [r.completed_amount for r in rankings.month_series(months, amount=True).collect()] == [100.0, 75.0]


def test_empty_snapshot(spark):
    empty = snapshot.overall(cleaning.snapshot_rows(snapshot_source(spark).where("false"))).first()
    assert (empty.total_transactions, empty.success_rate, empty.currency) == (0, 0.0, "INR")


@pytest.mark.parametrize(
    "column, value, report, message",
    [
        ("amount", "not-a-number", snapshot.banks, "invalid amounts"),
        ("amount", "-1", snapshot.banks, "invalid amounts"),
        ("is_successful", "unknown", snapshot.banks, "invalid is_successful"),
        ("is_failure", "maybe", snapshot.merchants, "invalid is_failure"),
        ("transaction_status", " ", snapshot.banks, "invalid statuses"),
        ("transaction_month", "2026", snapshot.months, "invalid transaction months"),
    ],
)
def test_bad_snapshot_values_fail(spark, column, value, report, message):
    bad = snapshot_source(spark).withColumn(column, F.lit(value))
    with pytest.raises(PySparkException, match=message):
        report(cleaning.snapshot_rows(bad)).collect()
    found = {r.column: r.violations for r in cleaning.snapshot_violations(bad).collect()}
    assert found[column] == 3
