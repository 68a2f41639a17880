import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from paygrain import model
from paygrain.operators import quality
from paygrain.sources import files
from tests.conftest import rows
from tests.fixtures import VALID, valid_tables


def broken(tables, **kwargs):
    found = quality.violations(tables, **kwargs).collect()
    return {(r.rule, r.dataset, r.column): r.violations for r in found}


def test_valid_set_has_no_violation(spark):
    assert broken(valid_tables(spark)) == {}


@pytest.mark.parametrize("name", list(VALID))
def test_doubled_table(spark, name):
    tables = valid_tables(spark)
    tables[name] = tables[name].unionByName(tables[name])
    assert broken(tables) == {("V3", name, model.PRIMARY_KEYS[name]): 1}


def test_missing_and_blank_values(spark):
    tables = valid_tables(spark, customers__age=None, merchants__merchant_status="   ")
    found = broken(tables)
    assert found[("V4", "customers", "age")] == 1
    assert found[("V4", "merchants", "merchant_status")] == 1
    assert found[("V15", "customers", "age")] == 1


def test_missing_columns_stop_cross_table_rules(spark):
    tables = valid_tables(spark, cards__customer_id="C404", merchants__merchant_id=" ")
    tables["customers"] = tables["customers"].drop("age", "annual_income")
    assert broken(tables) == {
        ("V2", "customers", "age"): 1,
        ("V2", "customers", "annual_income"): 1,
        ("V4", "merchants", "merchant_id"): 1,
        ("V5", "merchants", "merchant_id"): 1,
    }


def test_unreadable_datasets(spark, tmp_path):
    tables, problems = files.read_raw(spark, str(tmp_path))
    assert tables == {}
    assert problems["customers"].startswith("Required customers dataset not found")
    (tmp_path / "cards.csv").write_text("")
    _, problems = files.read_raw(spark, str(tmp_path))
    assert problems["cards"].startswith("Could not read cards dataset")
    tables = valid_tables(spark)
    del tables["customers"]
    found = broken(tables, problems={"customers": problems["customers"]})
    assert found == {("V1", "customers", ""): 1}


def test_out_of_range_numbers(spark):
    tables = valid_tables(
        spark,
        customers__age=17,
        customers__annual_income=float("inf"),
        transactions__amount=float("inf"),
    )
    assert broken(tables) == {
        ("V15", "customers", "age"): 1,
        ("V14", "customers", "annual_income"): 1,
        ("V16", "transactions", "amount"): 1,
    }


def test_wrong_owner(spark):
    tables = valid_tables(spark, transactions__customer_id="C2")
    second = tables["customers"].withColumn("customer_id", F.lit("C2"))
    tables["customers"] = tables["customers"].unionByName(second)
    assert broken(tables) == {("V7", "transactions", "customer_id"): 1}


def test_card_dates_domains_and_unparseable_dates(spark):
    tables = valid_tables(
        spark,
        cards__expiry_date="2024-01-01",
        transactions__transaction_date="not-a-date",
        transactions__transaction_status="Unknown",
        transactions__merchant_category="Unknown",
    )
    assert broken(tables) == {
        ("V11", "cards", "issue_date"): 1,
        ("V13", "cards", "expiry_date"): 1,
        ("V10", "transactions", "transaction_date"): 1,
        ("V9", "transactions", "transaction_status"): 1,
        ("V9", "transactions", "merchant_category"): 1,
        ("V8", "transactions", "merchant_category"): 1,
    }
    listed = rows(quality.invalid_values(tables))
    assert [(r["column"], r["value"], r["row_count"]) for r in listed] == [
        ("merchant_category", "Unknown", 1),
        ("transaction_status", "Unknown", 1),
    ]


def test_future_dates_and_category(spark):
    tables = valid_tables(
        spark,
        cards__issue_date="2026-10-08",
        cards__expiry_date="2026-10-06",
        transactions__transaction_date="2026-10-08",
        transactions__merchant_category="Grocery",
    )
    found = broken(tables, reference_date=date(2026, 10, 7))
    assert set(found) == {
        ("V12", "cards", "issue_date"),
        ("V12", "transactions", "transaction_date"),
        ("V13", "cards", "expiry_date"),
        ("V11", "cards", "issue_date"),
        ("V8", "transactions", "merchant_category"),
    }


def test_orphans(spark):
    tables = valid_tables(
        spark, cards__customer_id="C404", transactions__merchant_id="M404"
    )
    found = broken(tables)
    assert found[("V6", "cards", "customer_id")] == 1
    assert found[("V6", "transactions", "merchant_id")] == 1
    # A row without a parent counts as a mismatch as well.
    assert found[("V7", "transactions", "customer_id")] == 1
    assert found[("V8", "transactions", "merchant_category")] == 1


def test_owner_rule_has_no_verdict_while_cards_repeat(spark):
    tables = valid_tables(spark, transactions__customer_id="C2")
    tables["cards"] = tables["cards"].unionByName(tables["cards"])
    found = broken(tables)
    assert ("V7", "transactions", "customer_id") not in found
    assert found[("V3", "cards", "card_id")] == 1


def test_null_keys_repeat_each_other_and_have_no_parent(spark):
    tables = valid_tables(spark, transactions__merchant_id=None)
    counts = quality.link_counts(
        tables["transactions"], tables["merchants"], "merchant_id"
    )
    assert counts.first().orphans == 1
    nulls = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    assert quality.duplicate_rows(nulls, "k").first().violations == 1


def test_sql_owner_check_skips_unmatched_rows(spark):
    tables = valid_tables(spark, transactions__card_id="CARD404")
    found = {r.check: r.violations for r in quality.sql_checks(tables).collect()}
    assert found == {
        "invalid_transaction_card_links": 1,
        "invalid_transaction_customer_links": 0,
        "transaction_card_customer_mismatches": 0,
        "invalid_transaction_merchant_links": 0,
    }


def test_sql_owner_check_counts_joined_rows(spark):
    rng = random.Random(2)
    keys, owners = ["a", "b", "c", None], ["x", "y", "z", None]
    child = [(rng.choice(keys), rng.choice(owners)) for _ in range(120)]
    parent = [(rng.choice(keys), rng.choice(owners)) for _ in range(6)]
    schema = "k string, o string"
    got = quality.matched_mismatches(
        spark.createDataFrame(child, schema), spark.createDataFrame(parent, schema), "k", "o"
    ).first()
    expected = sum(
        1
        for k, o in child
        for pk, po in parent
        if k is not None and k == pk and o is not None and po is not None and o != po
    )
    assert got.mismatches == expected > 0


def test_link_counts_take_hot_keys(spark):
    child = spark.range(9000).select(
        F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.lit("x").alias("a"),
    )
    parent = spark.createDataFrame([("hot", "y")], "k string, a string")
    counts = quality.link_counts(child, parent, "k", "a").first()
    assert (counts.orphans, counts.mismatches) == (6000, 9000)


def test_sensitive_columns(spark):
    cards = spark.createDataFrame([("1", "2")], "card_id string, cvv string")
    assert quality.sensitive_columns({"c": cards}).first()[0] == 1
    assert quality.sensitive_columns({"c": cards.drop("cvv")}).first()[0] == 0


def test_card_preconditions(spark):
    tables = valid_tables(spark, cards__issue_date="2026-10-08")
    found = {
        r.check: r.violations
        for r in quality.card_preconditions(
            tables["customers"], tables["cards"]
        ).collect()
    }
    assert {k for k, v in found.items() if v} == {"issue_in_future"}
    empty = tables["cards"].where("false")
    found = quality.card_preconditions(tables["customers"], empty).collect()
    assert {r.check for r in found if r.violations} == {"no_cards"}
