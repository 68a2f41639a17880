import hashlib

import pytest
from pyspark.sql import functions as F

from paygrain import model
from paygrain.functions.draws import uniform
from paygrain.operators import generation, quality
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    customers = generation.customers(spark, 400)
    merchants = generation.merchants(spark, 50)
    cards = generation.cards(customers)
    return {
        "customers": customers,
        "cards": cards,
        "merchants": merchants,
        "transactions": generation.transactions(cards, customers, merchants),
    }


def test_generated_data_passes_validation(tables):
    assert rows(quality.violations(tables)) == []
    found = quality.card_preconditions(tables["customers"], tables["cards"]).collect()
    assert [r for r in found if r.violations] == []


def test_same_seed_same_data_under_any_partitioning(spark, tables):
    expected = rows(tables["transactions"], "transaction_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        customers = generation.customers(spark, 400).repartition(7)
        merchants = generation.merchants(spark, 50).repartition(3)
        cards = generation.cards(customers).repartition(5)
        again = generation.transactions(cards, customers, merchants)
        assert rows(again, "transaction_id") == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    other = generation.customers(spark, 400, seed=1)
    assert rows(other) != rows(tables["customers"])


def test_shape_of_the_tables(tables):
    per_customer = tables["cards"].groupBy("customer_id").count()
    assert {r["count"] for r in per_customer.collect()} == {1, 2, 3}
    uses = (
        tables["transactions"].groupBy("card_id").count()
        .join(tables["cards"], "card_id")
        .groupBy("card_status").agg(F.min("count"), F.max("count"))
    )
    limits = {r[0]: (r[1], r[2]) for r in uses.collect()}
    assert limits["Active"] == (4, 18)
    assert limits["Blocked"] == (1, 4)
    assert limits["Expired"] == (1, 2)
    for name, schema in (("customers", model.CUSTOMERS), ("merchants", model.MERCHANTS)):
        assert tables[name].columns == list(schema.names)
    days = tables["transactions"].agg(F.min("transaction_date"), F.max("transaction_date")).first()
    assert days[1] <= model.REFERENCE_DATE
    assert (model.REFERENCE_DATE - days[0]).days <= generation.HISTORY_DAYS


def test_draws_match_another_implementation(spark):
    seed, tag = 45, "amount"
    got = spark.range(0, 50).select(
        "id", uniform(seed, tag, F.col("id"), F.lit("K1")).alias("u")
    )
    for row in got.collect():
        digest = hashlib.md5(f"{seed}:{tag}:{row.id}:K1".encode()).hexdigest()
        assert row.u == int(digest[:13], 16) / 2**52


def test_gaps_in_merchant_ids_leave_no_row_without_a_merchant(spark, tables):
    few = tables["merchants"].where("merchant_id IN ('M000003', 'M000017', 'M000041')")
    odd = few.withColumn("merchant_id", F.concat("merchant_id", F.lit("-x")))
    for shops in (few, odd):
        tx = generation.transactions(tables["cards"], tables["customers"], shops)
        used = {r.merchant_id: r["count"] for r in tx.groupBy("merchant_id").count().collect()}
        assert set(used) == {r.merchant_id for r in shops.collect()}
        assert sum(used.values()) == tables["transactions"].count()
        assert min(used.values()) > 0.8 * max(used.values())
    none = generation.transactions(tables["cards"], tables["customers"], few.where("false"))
    assert none.count() == 0


def test_weights(spark):
    draws = spark.range(40000).select(
        F.when(F.lit(True), F.lit(1)).alias("one"),
        generation.weighted(uniform(1, "w", F.col("id")), generation.STATUS_WEIGHTS).alias("s"),
        generation.between(uniform(1, "b", F.col("id")), 18, 70).alias("age"),
    )
    counts = {r.s: r["count"] for r in draws.groupBy("s").count().collect()}
    for name, weight in generation.STATUS_WEIGHTS.items():
        assert counts[name] / 40000 == pytest.approx(weight / 100, abs=0.01)
    ages = draws.agg(F.min("age"), F.max("age"), F.countDistinct("age")).first()
    assert tuple(ages) == (18, 70, 53)


def test_amounts_follow_category_and_refund_rules(tables):
    tx = tables["transactions"]
    refunded = (F.col("transaction_type") == "Refund") & (F.col("transaction_status") == "Completed")
    for names, low, high in generation.AMOUNT_RANGES:
        part = tx.where(F.col("merchant_category").isin(*names))
        plain = part.where(~refunded).agg(F.min("amount"), F.max("amount")).first()
        assert low <= plain[0] and plain[1] <= high
        small = part.where(refunded).agg(F.max("amount")).first()[0]
        assert small <= high * generation.REFUND_SHARE[1]
    methods = {
        (r.card_type, r.payment_method)
        for r in tx.select("card_type", "payment_method").distinct().collect()
    }
    assert ("Credit", "ATM") not in methods and ("Debit", "EMV") not in methods


def test_ids_are_never_cut(spark):
    df = spark.createDataFrame([(7,), (123456789,)], "n long")
    ids = [r.i for r in df.select(generation.identifier("C", F.col("n"), 6).alias("i")).collect()]
    assert ids == ["C000007", "C123456789"]
