from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paygrain import model
from paygrain.functions import values
from paygrain.operators import cleaning, rankings
from paygrain.plans import snapshot
from tests.conftest import rows

RAW = "transaction_id string, transaction_date string, amount string, transaction_status string, n int"


def raw(spark, *data):
    return spark.createDataFrame([(*row, i) for i, row in enumerate(data)], RAW)


def test_only_the_valid_first_copy_stays(spark):
    df = raw(
        spark,
        ("T1", "2026-01-01", "10.50", "Completed"),
        ("T1", "2026-01-01", "10.50", "Completed"),
        ("T2", "2026-01-02", "0", "Failed"),
        ("T3", "2026-01-03", "inf", "Failed"),
        ("T4", "2026-01-03", "NaN", "Failed"),
        ("T5", "2026-01-03", "-4", "Failed"),
        ("T6", "2026-01-03", "ten", "Failed"),
        ("T7", "2026-01-03", "10d", "Failed"),
        ("T8", "2026-01-03", None, "Failed"),
    )
    result = rows(cleaning.clean_transactions(df, ["n"]).drop("n"))
    assert result == [
        {
            "transaction_id": "T1",
            "transaction_date": date(2026, 1, 1),
            "amount": Decimal("10.50"),
            "transaction_status": "Completed",
            "transaction_month": "2026-01",
            "is_successful": True,
            "is_failure": False,
        }
    ]


def test_an_invalid_first_copy_closes_its_id(spark):
    df = raw(
        spark,
        ("T1", "2026-01-01", "0", "Completed"),
        ("T1", "2026-01-01", "10", "Completed"),
        ("T2", "2026-01-01", " 1e2 ", "Failed"),
    )
    result = cleaning.clean_transactions(df, ["n"]).collect()
    assert [(r.transaction_id, r.amount, r.is_failure) for r in result] == [
        ("T2", Decimal("100.00"), True)
    ]


def test_first_follows_the_given_order(spark):
    df = raw(
        spark,
        ("T1", "2026-01-01", "1", "Completed"),
        ("T1", "2026-01-01", "2", "Completed"),
    )
    last = cleaning.clean_transactions(df, [F.desc("n")]).first()
    assert last.amount == Decimal("2.00")


def test_bad_dates_fail_the_job(spark):
    df = raw(spark, ("T1", "not-a-date", "1", "Completed"))
    with pytest.raises(PySparkException):
        cleaning.clean_transactions(df, ["n"]).collect()


def test_null_date_stays_null(spark):
    df = raw(spark, ("T1", None, "1", None))
    row = cleaning.clean_transactions(df, ["n"]).first()
    assert (row.transaction_month, row.is_successful, row.is_failure) == (
        None,
        False,
        False,
    )


def test_a_hot_key_sends_one_row_per_input_partition(spark):
    df = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id"
    )
    first = cleaning.keep_first(df, ["key"], ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle
    assert first.count() == 20001


def test_public_cards_and_contacts(spark):
    cards = spark.createDataFrame([("1", "2", "3")], "card_id string, card_number string, cvv string")
    assert cleaning.public_cards(cards).columns == ["card_id"]
    assert cleaning.public_cards(cards.select("card_id")).columns == ["card_id"]
    shops = spark.createDataFrame(
        [("M", "a", "b", "c")], "merchant_id string, contact_person string, email string, phone string"
    )
    assert cleaning.without_contacts(shops).columns == ["merchant_id"]


@pytest.mark.parametrize(
    "text, expected",
    [("true", True), (" TRUE ", True), ("1", True), ("False", False), ("0", False)],
)
def test_flags_parse(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    flag = values.flag(F.col("v"), df.schema["v"].dataType, "v")
    assert df.select(flag.alias("f")).first().f is expected


@pytest.mark.parametrize("text", ["unknown", "", None])
def test_other_flag_text_is_an_error(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    flag = values.flag(F.col("v"), df.schema["v"].dataType, "is_successful")
    with pytest.raises(PySparkException, match="invalid is_successful values"):
        df.select(flag).collect()


def test_native_null_flag_is_false(spark):
    df = spark.createDataFrame([(None,)], "v boolean")
    flag = values.flag(F.col("v"), df.schema["v"].dataType, "v")
    assert df.select(flag.alias("f")).first().f is False


def test_strip_removes_all_white_space(spark):
    samples = ["\t a b \n", " x ", "\x1cy\x1f", "", "  "]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r.s for r in df.select(values.strip(F.col("v")).alias("s")).collect()]
    assert got == [s.strip() for s in samples]


def text_rows(spark, **bad):
    """A snapshot of two categories, the last row with the given values."""
    good = {
        "merchant_category": "Retail", "merchant_name": "Shop", "transaction_status": " Completed",
        "transaction_month": "2026-01", "amount": "10.50", "currency": "INR",
        "bank_name": "Axis Bank", "is_successful": " TRUE ", "is_failure": "0",
    }
    assert set(good) == set(model.SAFE_COLUMNS)
    last = good | {"merchant_category": "Travel"} | bad
    schema = ", ".join(f"{name} string" for name in good)
    return spark.createDataFrame([tuple(good.values()), tuple(last.values())], schema)


ANSWERS = {
    "overall": snapshot.overall,
    "banks": snapshot.banks,
    "merchants": snapshot.merchants,
    "categories": snapshot.categories,
    "months": snapshot.months,
    "currency": lambda rows: rows.groupBy("currency").count(),
    "one category": lambda rows: rankings.compare(snapshot.categories(rows), "category", ["retail"]),
    "rows": lambda rows: rows.where("merchant_category = 'Retail'").select("merchant_name"),
}


@pytest.mark.parametrize("answer", ANSWERS)
def test_one_bad_value_rejects_the_whole_snapshot(spark, answer):
    """Whatever the answer reads: here a month, a flag and an amount it may not need."""
    assert ANSWERS[answer](cleaning.snapshot_rows(text_rows(spark))).collect()
    for bad, message in (
        ({"transaction_month": "2026-1"}, "invalid transaction months"),
        ({"is_failure": "unknown"}, "invalid is_failure values"),
        ({"amount": "0"}, "invalid amounts"),
        ({"transaction_status": " "}, "invalid statuses"),
    ):
        rows = cleaning.snapshot_rows(text_rows(spark, **bad))
        with pytest.raises(PySparkException, match=message):
            ANSWERS[answer](rows).collect()


def test_violations_are_counted_per_column(spark):
    rows = text_rows(spark, amount="1e400", transaction_status=None, is_successful=None)
    counted = dict(cleaning.snapshot_violations(rows).collect())
    assert counted == {
        "amount": 1, "transaction_status": 1, "transaction_month": 0, "is_successful": 1, "is_failure": 0
    }


def test_an_empty_snapshot_passes(spark):
    rows = cleaning.snapshot_rows(text_rows(spark).where("false"))
    assert snapshot.overall(rows).first().total_transactions == 0
