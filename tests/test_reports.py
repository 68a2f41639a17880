from datetime import date

import pytest
from pyspark.sql import functions as F

from paygrain import model
from paygrain.operators import filters, measures
from paygrain.operators.anomalies import amount_anomalies, known_anomalies
from paygrain.plans import reports
from tests.conftest import rows
from tests.fixtures import served, served_row


def test_summary(spark):
    assert rows(reports.service_summary(served(spark))) == [
        {
            "total_transactions": 3,
            "completed_transactions": 2,
            "completed_amount": 150.0,
            "success_rate": 2 / 3,
            "active_customers": 2,
            "currency": "INR",
        }
    ]


def test_summary_of_nothing(spark):
    assert rows(reports.service_summary(served(spark).where("false"))) == [
        {
            "total_transactions": 0,
            "completed_transactions": 0,
            "completed_amount": 0.0,
            "success_rate": 0.0,
            "active_customers": 0,
            "currency": "INR",
        }
    ]


def test_summary_counts_customers_across_currencies_and_skips_nulls(spark):
    more = [
        served_row(4, "C1", "M1", "Shop One", "Retail", 1, "Completed", "B", "Debit", currency="USD"),
        served_row(5, None, "M1", "Shop One", "Retail", 1, "Failed", "B", "Debit", currency="EUR"),
        served_row(6, "C3", "M1", "Shop One", "Retail", 1, "Failed", "B", "Debit", currency=None),
    ]
    got = reports.service_summary(served(spark, more)).first()
    assert (got.total_transactions, got.active_customers, got.currency) == (6, 3, "INR")
    assert got.completed_amount == 151.0


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "v string")
    assert measures.most_frequent(df, "v").first().v == "a"


def test_page_and_filters(spark):
    tx = served(spark)
    page = filters.page(tx, limit=1, offset=1).collect()
    assert [(r.total, r.limit, r.offset, r.transaction_id) for r in page] == [(3, 1, 1, "T2")]
    chosen = filters.page(filters.filter_ci(tx, "retail", "completed"))
    assert [r.total for r in chosen.collect()] == [2, 2]
    hidden = {"customer_id", "card_id", "card_number", "cvv"}
    assert not hidden & set(chosen.columns)
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            filters.page(tx, **bad)


def test_case_insensitive_filter_details(spark):
    tx = served(spark, [served_row(4, "C1", "M1", "S", None, 1, "Failed", "B", "Debit")])
    assert filters.filter_ci(tx).count() == 4
    assert filters.filter_ci(tx, "").count() == 4
    assert filters.filter_ci(tx, "  ").count() == 0
    assert filters.filter_ci(tx, " RETAIL ").count() == 2


def test_exact_filters(spark):
    tx = served(spark)
    assert filters.filter_in(tx, ["retail"]).count() == 0
    assert filters.filter_in(tx, ["Retail"], banks=["Example Bank"]).count() == 2
    assert filters.filter_in(tx, statuses=["Failed", "Completed"]).count() == 3


def test_service_groups(spark):
    tx = served(spark)
    assert [r["category"] for r in rows(reports.service_categories(tx))] == ["Grocery", "Retail"]
    banks = rows(reports.service_banks(tx))
    assert [(r["bank_name"], r["completed_transactions"]) for r in banks] == [
        ("Another Bank", 0),
        ("Example Bank", 2),
    ]
    top = reports.service_merchants(tx, 1).first()
    assert (top.merchant_id, top.failure_rate, top.completed_amount) == ("M1", 0.0, 150.0)
    with pytest.raises(ValueError):
        reports.service_merchants(tx, 101)


def test_null_keys_by_kind_of_report(spark):
    tx = served(spark, [served_row(4, "C9", "M1", "S", None, 7, "Completed", None, "Debit")])
    assert reports.category_performance(tx).count() == 2
    assert reports.category_kpi(tx).count() == 3
    assert reports.service_banks(tx).count() == 2
    assert reports.bank_card_mix(tx).count() == 3


def test_kpi_and_measures(spark):
    tx = served(spark)
    assert reports.kpi(tx).first().asDict() == {
        "completed_amount": 150.0,
        "total_transactions": 3,
        "active_customers": 2,
        "success_rate_pct": 66.67,
    }
    by_bank = {r.bank_name: r for r in measures.measures(tx, "bank_name").collect()}
    assert by_bank["Another Bank"].average_completed_ticket == 0.0
    assert by_bank["Another Bank"].failure_rate == 1.0
    assert by_bank["Example Bank"].average_completed_ticket == 75.0
    empty = measures.measures(tx.where("false")).first()
    assert (empty.transaction_count, empty.success_rate, empty.completed_amount) == (0, 0.0, 0.0)


def test_dashboard_gate(spark):
    tx = served(spark)
    nothing = reports.dashboard_kpi(tx, ()).first()
    assert tuple(nothing) == (0.0, 0, 0, 0.0)
    chosen = reports.dashboard_kpi(tx, ["Retail"], statuses=["Completed"]).first()
    assert tuple(chosen) == (150.0, 2, 1, 1.0)


def test_dashboard_tables(spark):
    tx = served(spark)
    assert rows(reports.dashboard_categories(tx)) == [
        {"merchant_category": "Retail", "completed_amount": 150.0}
    ]
    assert rows(reports.bank_card_pivot(tx)) == [
        {"bank_name": "Example Bank", "Credit": 0.0, "Debit": 150.0}
    ]
    many = tx
    for _ in range(2):
        many = many.unionByName(many)
    worst = reports.dashboard_failing_merchants(many, min_count=4, as_text=True).collect()
    assert [(r.merchant_id, r.failure_rate) for r in worst] == [("M2", "100.0%"), ("M1", "0.0%")]
    assert reports.dashboard_failing_merchants(tx).count() == 0
    latest = filters.latest_first(tx).collect()
    assert [r.transaction_id for r in latest] == ["T3", "T2", "T1"]
    assert tuple(latest[0].asDict()) == model.DISPLAY_COLUMNS


def test_merchant_risk_is_strictly_above_the_overall_rate(spark):
    good = [
        served_row(i, "C1", "M3", "Shop", "Travel", 1, "Completed", "B", "Debit") for i in range(1, 6)
    ]
    bad = [
        served_row(i, "C1", "M4", "Shop", "Travel", 1, "Failed", "B", "Debit") for i in range(10, 15)
    ]
    tx = spark.createDataFrame(good + bad, served(spark).schema)
    risky = reports.merchant_risk(tx).collect()
    assert [(r.merchant_id, r.failure_rate_pct) for r in risky] == [("M4", 100.0)]
    only = reports.merchant_risk(tx.where("merchant_id = 'M4'"))
    assert only.count() == 0


def test_summaries_add_up(spark, sf):
    from paygrain.sources import orders_feed as feed

    tx = feed.full_transactions(spark, sf)
    overall = reports.kpi(tx).first()
    merchants = reports.merchant_summary(tx).agg(
        F.sum("transaction_count"), F.sum("completed_amount").cast("decimal(18,2)")
    ).first()
    months = reports.monthly_performance(tx).agg(
        F.sum("transaction_count"), F.sum("completed_amount").cast("decimal(18,2)")
    ).first()
    statuses = reports.status_distribution(tx).agg(F.sum("transaction_count")).first()
    assert merchants[0] == months[0] == statuses[0] == overall.total_transactions
    assert merchants[1] == months[1]
    assert float(merchants[1]) == pytest.approx(overall.completed_amount, abs=0.01)


def test_anomalies(spark):
    data = [(i, 10.0) for i in range(20)] + [(99, 1000.0)]
    df = spark.createDataFrame(data, "id int, amount double")
    flagged = amount_anomalies(df, key="id").collect()
    assert [r.id for r in flagged] == [99]
    assert flagged[0].amount_anomaly is True
    one = spark.createDataFrame([(1, 5.0)], "id int, amount double")
    assert amount_anomalies(one, key="id").count() == 0
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, amount double")
    assert amount_anomalies(same, key="id").count() == 0
    low = spark.createDataFrame([(i, 10.0) for i in range(20)] + [(99, -1000.0)], "id int, amount double")
    assert [r.id for r in amount_anomalies(low, key="id").collect()] == [99]


def test_document_customers_have_a_set_of_categories(spark):
    tx = served(spark, [served_row(4, "C1", "M2", "Shop Two", "Grocery", 1, "Completed", "B", "Debit")])
    got = reports.document_customers(tx).first()
    assert (got.customer_id, got.completed_spend, got.transactions) == ("C1", 151.0, 3)
    assert got.categories == ["Grocery", "Retail"]


def test_monthly_reports_differ_on_months_without_success(spark):
    tx = served(
        spark,
        [
            served_row(
                4, "C1", "M2", "Shop Two", "Grocery", 1, "Failed", "B", "Debit",
                transaction_month="2026-02", transaction_date=date(2026, 2, 1),
            )
        ],
    )
    assert reports.monthly_trend(tx).count() == 2
    assert reports.document_monthly(tx).count() == 1
    assert reports.dashboard_monthly(tx).count() == 2


@pytest.mark.parametrize("shallow", [10_000, 0])
def test_pages_at_any_offset(spark, monkeypatch, shallow):
    """By top-k and by counts per range of ids; ids of all shapes, repeated and null."""
    monkeypatch.setattr(filters, "SHALLOW", shallow)
    ids = [f"TXN{i:012d}" for i in range(0, 4000, 7)] + ["B", "A99999", "TXN", "TXN1", None, "é" * 12]
    ids += ["TXN000000000007"] * 3
    base = served(spark).limit(1).drop("transaction_id")
    tx = spark.createDataFrame([(i,) for i in ids], "transaction_id string").crossJoin(base)
    ordered = sorted(ids, key=lambda i: (i is not None, (i or "").encode()))
    for offset in (0, 1, 3, 95, 571, 580, 5000):
        page = filters.page(tx, 10, offset).collect()
        assert [r.transaction_id for r in page] == ordered[offset : offset + 10]
        assert {r.total for r in page} <= {len(ids)}
    after = filters.page(tx, 3, after="TXN000000003990", complete=lambda rows: rows).collect()
    assert [r.transaction_id for r in after] == ["TXN000000003997", "TXN1", "é" * 12]


def test_a_deep_page_moves_few_wide_rows(spark, monkeypatch):
    """Before the page is cut out only ids and counts travel, and nothing is gathered."""
    monkeypatch.setattr(filters, "SHALLOW", 0)
    plan = filters.page(served(spark), 10, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "GlobalLimit" not in plan


@pytest.mark.parametrize("kind", ["decimal(12,2)", "double"])
def test_known_bounds_find_the_same_anomalies(spark, tmp_path, kind):
    """The scores' threshold as bounds of the column: equality counts, row groups are skipped."""
    amounts = [100.0] * 4000 + [90.0] * 4000 + [110.0] * 4000 + [9000.0, 9000.0, 0.01]
    tx = spark.createDataFrame(list(enumerate(amounts)), "id int, amount double").selectExpr(
        "concat('T', id) AS transaction_id", f"CAST(amount AS {kind}) AS amount"
    )
    path = str(tmp_path / "fact")
    tx.orderBy("amount").coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    fact = spark.read.parquet(path)
    stats = measures.spread(fact, "amount").first()
    wanted = amount_anomalies(fact).collect()
    found = known_anomalies(fact, stats.mean, stats.std)
    assert [r.transaction_id for r in found.collect()] == [r.transaction_id for r in wanted]
    assert len(wanted) == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThanOrEqual(amount" in plan or "GreaterThanOrEqual(amount" in plan
    for edge in (9000.0, 0.01):
        spread = abs(edge - 100.0) / 2.0
        exact = known_anomalies(fact, 100.0, spread, 2.0).collect()
        assert edge in {float(r.amount) for r in exact}
    assert known_anomalies(fact, 100.0, 0.0).collect() == []
    assert known_anomalies(fact, None, None).collect() == []
    assert known_anomalies(fact, 1e12, 1.0).count() == 12003
