"""Synthetic payments data as Spark jobs.

Every value is a function of (seed, row key), so the tables come out the same
on any cluster and a lost task recomputes exactly what it had produced.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrain import model
from paygrain.functions.draws import between, choice, uniform, weighted
from paygrain.functions.values import money
from paygrain.operators.enrichment import owned_cards
from paygrain.operators.filters import with_place

# Seeds, value lists, weights, ranges.
CUSTOMER_SEED = 42
CARD_SEED = 43
MERCHANT_SEED = 44
TRANSACTION_SEED = 45
PLACES = (
    ("Hyderabad", "Telangana"),
    ("Bengaluru", "Karnataka"),
    ("Mumbai", "Maharashtra"),
    ("Chennai", "Tamil Nadu"),
    ("Delhi", "Delhi"),
    ("Pune", "Maharashtra"),
    ("Kolkata", "West Bengal"),
    ("Ahmedabad", "Gujarat"),
    ("Jaipur", "Rajasthan"),
    ("Lucknow", "Uttar Pradesh"),
)
OCCUPATIONS = (
    "Software Engineer",
    "Doctor",
    "Teacher",
    "Data Analyst",
    "Bank Manager",
    "Student",
    "Business Owner",
    "Accountant",
    "Civil Engineer",
    "Marketing Executive",
)
STATUS_WEIGHTS = {
    "Completed": 72,
    "Pending": 12,
    "Failed": 8,
    "Refunded": 6,
    "Disputed": 2,
}
LEISURE_STATUS_WEIGHTS = {
    "Completed": 68,
    "Pending": 14,
    "Failed": 10,
    "Refunded": 6,
    "Disputed": 2,
}
LEISURE = ("Travel", "Entertainment")
TYPE_WEIGHTS = {
    "Purchase": 70,
    "Refund": 12,
    "Bill Payment": 8,
    "Wallet Top-up": 5,
    "Merchant Payment": 5,
}
CREDIT_METHODS = ("Chip", "Contactless", "Online", "EMV")
DEBIT_METHODS = ("Chip", "Contactless", "Online", "ATM")
AMOUNT_RANGES = (
    (("Grocery", "Restaurants", "Retail"), 80, 3500),
    (("Education", "Online Services", "Health & Wellness"), 200, 6000),
)
OTHER_AMOUNT_RANGE = (300, 10000)
REFUND_SHARE = (0.1, 0.6)
CARD_USES = {"Blocked": (0, 4), "Expired": (0, 2)}
ACTIVE_CARD_USES = (4, 18)
MAX_CARDS = 3
HISTORY_DAYS = 540

# Characters that merchant ids of one range, and of one group of ranges, share.
MERCHANT_RANGES = (5, 3)


def identifier(prefix: str, index: Column, width: int) -> Column:
    """Zero-padded id that grows past its usual width instead of being cut."""
    text = index.cast("string")
    return F.concat(
        F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))
    )


def _index(column: str) -> Column:
    """The number inside a generated id."""
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long")


def _place(draw: Column) -> Column:
    pairs = [
        F.struct(F.lit(city).alias("city"), F.lit(state).alias("state"))
        for city, state in PLACES
    ]
    return F.element_at(F.array(*pairs), between(draw, 1, len(PLACES)))


def _phone(draw: Column) -> Column:
    digits = F.floor(draw * 10_000_000_000).cast("string")
    return F.lpad(digits, 10, "0")


def customers(
    spark: SparkSession,
    count: int,
    seed: int = CUSTOMER_SEED,
    reference_date: date = model.REFERENCE_DATE,
) -> DataFrame:
    return customer_rows(spark.range(1, count + 1), seed, reference_date)


def customer_rows(
    index: DataFrame, seed: int, reference_date: date = model.REFERENCE_DATE
) -> DataFrame:
    """Customers for the given ``id`` numbers."""
    key = F.col("id")

    def draw(what: str) -> Column:
        return uniform(seed, what, key)

    return index.withColumn("_place", _place(draw("place"))).select(
        identifier("C", key, 6).alias("customer_id"),
        F.concat(F.lit("Given"), key).alias("first_name"),
        F.concat(F.lit("Family"), key).alias("last_name"),
        choice(draw("gender"), ("Male", "Female")).alias("gender"),
        between(draw("age"), 18, 70).alias("age"),
        F.concat(F.lit("customer"), key, F.lit("@example.com")).alias("email"),
        _phone(draw("phone")).alias("phone"),
        F.col("_place.city").alias("city"),
        F.col("_place.state").alias("state"),
        choice(draw("occupation"), OCCUPATIONS).alias("occupation"),
        money(between(draw("income"), *model.INCOME_RANGE)).alias("annual_income"),
        F.date_sub(F.lit(reference_date), between(draw("since"), 0, 365 * 3)).alias(
            "registration_date"
        ),
    )


def merchants(
    spark: SparkSession,
    count: int,
    seed: int = MERCHANT_SEED,
    reference_date: date = model.REFERENCE_DATE,
) -> DataFrame:
    return merchant_rows(spark.range(1, count + 1), seed, reference_date)


def merchant_rows(
    index: DataFrame, seed: int, reference_date: date = model.REFERENCE_DATE
) -> DataFrame:
    """Merchants for the given ``id`` numbers."""
    key = F.col("id")

    def draw(what: str) -> Column:
        return uniform(seed, what, key)

    return index.withColumn("_place", _place(draw("place"))).select(
        identifier("M", key, 6).alias("merchant_id"),
        F.concat(F.lit("Merchant "), key).alias("merchant_name"),
        choice(draw("category"), model.CATEGORIES).alias("merchant_category"),
        F.col("_place.city").alias("city"),
        F.col("_place.state").alias("state"),
        F.concat(F.lit("Contact "), key).alias("contact_person"),
        F.concat(F.lit("merchant"), key, F.lit("@example.com")).alias("email"),
        _phone(draw("phone")).alias("phone"),
        F.date_sub(F.lit(reference_date), between(draw("since"), 0, 365 * 5)).alias(
            "registration_date"
        ),
        choice(draw("status"), model.MERCHANT_STATUSES).alias("merchant_status"),
    )


def cards(
    customers: DataFrame,
    seed: int = CARD_SEED,
    reference_date: date = model.REFERENCE_DATE,
) -> DataFrame:
    """One to three cards per customer, numbered by customer and position."""
    owner = F.col("customer_id")
    owned = customers.select(
        "customer_id",
        F.explode(
            F.sequence(F.lit(1), between(uniform(seed, "cards", owner), 1, MAX_CARDS))
        ).alias("_nth"),
    )

    def draw(what: str) -> Column:
        return uniform(seed, what, owner, F.col("_nth"))

    number = (_index("customer_id") - 1) * MAX_CARDS + F.col("_nth")
    reference = F.lit(reference_date)
    return owned.select(
        identifier("CARD", number, 6).alias("card_id"),
        "customer_id",
        choice(draw("type"), model.CARD_TYPES).alias("card_type"),
        choice(draw("bank"), model.BANKS).alias("bank_name"),
        F.lit("Visa").alias("card_network"),
        F.date_sub(reference, between(draw("issue"), 0, 365 * 3)).alias("issue_date"),
        F.date_add(reference, between(draw("expiry"), 365, 365 * 6)).alias(
            "expiry_date"
        ),
        choice(draw("status"), model.CARD_STATUSES).alias("card_status"),
    )


def _uses(status: Column, draw: Column) -> Column:
    count = None
    for name, (low, high) in CARD_USES.items():
        value = between(draw, low, high)
        test = status == name
        count = F.when(test, value) if count is None else count.when(test, value)
    return count.otherwise(between(draw, *ACTIVE_CARD_USES))


def _amount(category: Column, draw: Column) -> Column:
    def within(low: int, high: int) -> Column:
        return money(F.lit(low) + draw * (high - low))

    amount = None
    for names, low, high in AMOUNT_RANGES:
        test = category.isin(*names)
        amount = (
            F.when(test, within(low, high))
            if amount is None
            else amount.when(test, within(low, high))
        )
    return amount.otherwise(within(*OTHER_AMOUNT_RANGE))


def transactions(
    cards: DataFrame,
    customers: DataFrame,
    merchants: DataFrame,
    seed: int = TRANSACTION_SEED,
    reference_date: date = model.REFERENCE_DATE,
) -> DataFrame:
    """Transactions per card by card status, each at a random merchant.

    A draw is a merchant's place in the order of the ids, whatever these are;
    its attributes come by an ordinary join on the place.
    """
    merchant_count = merchants.select(F.count(F.lit(1))).scalar()
    card = F.col("card_id")
    per_card = ACTIVE_CARD_USES[1]
    used = owned_cards(cards, customers).withColumn(
        "_uses", _uses(F.trim("card_status"), uniform(seed, "uses", card))
    )
    rows = used.where(F.col("_uses") > 0).withColumn(
        "_nth", F.explode(F.sequence(F.lit(1), F.col("_uses")))
    )

    def draw(what: str) -> Column:
        return uniform(seed, what, card, F.col("_nth"))

    index = F.floor(draw("merchant") * merchant_count).cast("long")
    shops = with_place(
        merchants.select(
            "merchant_id",
            "merchant_name",
            "merchant_category",
            F.col("city").alias("merchant_city"),
            F.col("state").alias("merchant_state"),
        ),
        "merchant_id",
        *MERCHANT_RANGES,
    )
    placed = rows.withColumn("_index", index).join(shops, F.col("_index") == F.col("_place"))
    category = F.col("merchant_category")
    status = F.when(
        category.isin(*LEISURE), weighted(draw("status"), LEISURE_STATUS_WEIGHTS)
    ).otherwise(weighted(draw("status"), STATUS_WEIGHTS))
    drawn = placed.withColumns(
        {
            "transaction_status": status,
            "transaction_type": weighted(draw("type"), TYPE_WEIGHTS),
            "_amount": _amount(category, draw("amount")),
        }
    )
    low, high = REFUND_SHARE
    refunded = money(
        F.col("_amount").cast("double") * (F.lit(low) + draw("refund") * (high - low))
    )
    is_refund = (F.col("transaction_type") == "Refund") & (
        F.col("transaction_status") == "Completed"
    )
    number = (_index("card_id") - 1) * per_card + F.col("_nth")
    method = F.when(
        F.col("card_type") == "Credit", choice(draw("method"), CREDIT_METHODS)
    ).otherwise(choice(draw("method"), DEBIT_METHODS))
    return drawn.select(
        identifier("TXN", number, 9).alias("transaction_id"),
        "card_id",
        "customer_id",
        "merchant_id",
        "merchant_name",
        "merchant_category",
        F.date_sub(
            F.lit(reference_date), between(draw("day"), 0, HISTORY_DAYS)
        ).alias("transaction_date"),
        F.when(is_refund, refunded).otherwise(F.col("_amount")).alias("amount"),
        F.lit("INR").alias("currency"),
        "transaction_type",
        "transaction_status",
        method.alias("payment_method"),
        "merchant_city",
        "merchant_state",
        "bank_name",
        "card_type",
        "customer_city",
        "customer_state",
        F.concat(F.lit("Synthetic payment "), F.col("_nth")).alias("description"),
    )
