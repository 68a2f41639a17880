"""The payments model over order data (lineitem, orders, customer, supplier...).

An order line is a transaction, an order names the card and its owner, a
supplier is a merchant. Text columns and lookups are derived after the
duplicate check, so what it shuffles are a few numbers per line. Lookups are
joined only when a report asks for them: they match at most one row each, so
leaving one out changes no other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrain import model
from paygrain.functions.values import money
from paygrain.operators.cleaning import first_valid, with_derived
from paygrain.operators.generation import identifier

# What makes two lines copies of one transaction, and which copy comes first.
LINE_KEY = ("order_key", "line_number")
LINE_ORDER = (
    "transaction_date",
    "amount",
    "part_key",
    "supp_key",
    "return_flag",
    "line_status",
)

TRANSACTION_COLUMNS = (
    "transaction_id",
    "card_id",
    "customer_id",
    "merchant_id",
    "merchant_name",
    "merchant_category",
    "transaction_date",
    "amount",
    "currency",
    "transaction_type",
    "transaction_status",
    "payment_method",
    "merchant_city",
    "merchant_state",
    "bank_name",
    "card_type",
    "customer_city",
    "customer_state",
    "description",
)
DERIVED_COLUMNS = ("transaction_month", "is_successful", "is_failure")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nth(index: Column, options) -> Column:
    """The option at a zero-based index."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def merchant_id(key: Column) -> Column:
    return identifier("M", key, 6)


def customer_id(key: Column) -> Column:
    return identifier("C", key, 8)


def card_id(key: Column, digit: Column) -> Column:
    return F.concat(identifier("CARD", key, 8), F.lit("-"), digit.cast("string"))


def _category(supp_key: Column) -> Column:
    return _nth(supp_key % len(model.CATEGORIES), model.CATEGORIES)


def _bank(digit: Column) -> Column:
    return _nth(digit - 1, model.BANKS)


def _card_type(cust_key: Column, digit: Column) -> Column:
    return F.when((cust_key + digit) % 2 == 0, "Credit").otherwise("Debit")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as bare keys, flags, date and amount."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        F.col("l_extendedprice").alias("amount"),
    )


def _described(lines: DataFrame) -> DataFrame:
    """Add what a line alone determines: ids, category, status, type, method."""
    bucket = (
        F.col("order_key") * 7 + F.col("part_key") * 13 + F.col("supp_key")
    ) % 100
    status = (
        F.when(bucket < 72, "Completed")
        .when(bucket < 84, "Pending")
        .when(bucket < 92, "Failed")
        .when(bucket < 98, "Refunded")
        .otherwise("Disputed")
    )
    method = (
        F.when(F.col("return_flag") == "A", "Chip")
        .when(F.col("return_flag") == "N", "Contactless")
        .when(F.col("line_status") == "F", "Online")
        .otherwise("EMV")
    )
    kind = (
        F.when(F.col("line_number") == 1, "Refund")
        .when(F.col("line_number") == 2, "Bill Payment")
        .when(F.col("line_number") == 3, "Wallet Top-up")
        .when(F.col("line_number") == 4, "Merchant Payment")
        .otherwise("Purchase")
    )
    return lines.withColumns(
        {
            "transaction_id": identifier(
                "TXN", F.col("order_key") * 10 + F.col("line_number"), 12
            ),
            "merchant_id": merchant_id(F.col("supp_key")),
            "merchant_category": _category(F.col("supp_key")),
            "currency": F.lit("INR"),
            "transaction_type": kind,
            "transaction_status": status,
            "payment_method": method,
            "description": F.concat(F.lit("Part "), F.col("part_key")),
        }
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .join(
            table(spark, sf_dir, "region"),
            F.col("n_regionkey") == F.col("r_regionkey"),
            "left",
        )
        .select(
            "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")
        )
    )


def _with_card(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cust_key"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("digit"),
    )
    key, digit = F.col("cust_key"), F.col("digit")
    return df.join(orders, "order_key", "left").withColumns(
        {
            "customer_id": customer_id(key),
            "card_id": card_id(key, digit),
            "bank_name": _bank(digit),
            "card_type": _card_type(key, digit),
        }
    )


def _with_place(
    df: DataFrame, spark: SparkSession, sf_dir: str, nation_key: str, prefix: str
) -> DataFrame:
    """City and state of a nation key.

    Joined straight onto the rows: a dimension joined to its places beforehand
    looks far larger to Spark than it is and would not be broadcast.
    """
    places = _places(spark, sf_dir).select(
        F.col("n_nationkey").alias(nation_key),
        F.col("city").alias(f"{prefix}_city"),
        F.col("state").alias(f"{prefix}_state"),
    )
    return df.join(places, nation_key, "left")


def _with_customer_place(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust_key"), F.col("c_nationkey").alias("home_key")
    )
    return _with_place(
        df.join(homes, "cust_key", "left"), spark, sf_dir, "home_key", "customer"
    )


def _with_merchant(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supp_key"),
        F.col("s_name").alias("merchant_name"),
        F.col("s_nationkey").alias("shop_key"),
    )
    return df.join(shops, "supp_key", "left")


def _with_merchant_place(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_place(df, spark, sf_dir, "shop_key", "merchant")


def _attached(
    df: DataFrame,
    spark: SparkSession,
    sf_dir: str,
    card: bool = False,
    customer_place: bool = False,
    merchant: bool = False,
    merchant_place: bool = False,
) -> DataFrame:
    if card or customer_place:
        df = _with_card(df, spark, sf_dir)
    if customer_place:
        df = _with_customer_place(df, spark, sf_dir)
    if merchant or merchant_place:
        df = _with_merchant(df, spark, sf_dir)
    if merchant_place:
        df = _with_merchant_place(df, spark, sf_dir)
    return df


EVERY_LOOKUP = {
    "card": True,
    "customer_place": True,
    "merchant": True,
    "merchant_place": True,
}


def transactions(spark: SparkSession, sf_dir: str, **lookups: bool) -> DataFrame:
    """The cleaned fact with the requested lookups.

    Lookups: card, customer_place, merchant, merchant_place.
    """
    first = first_valid(_lines(spark, sf_dir), LINE_KEY, LINE_ORDER)
    described = with_derived(_described(first))
    wide = _attached(described, spark, sf_dir, **lookups)
    known = [*TRANSACTION_COLUMNS, *DERIVED_COLUMNS]
    return wide.select(*[name for name in known if name in wide.columns])


def full_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir, **EVERY_LOOKUP)


def raw_transactions(spark: SparkSession, sf_dir: str, **lookups: bool) -> DataFrame:
    """All lines as raw transactions: copies included, nothing derived."""
    wide = _attached(_described(_lines(spark, sf_dir)), spark, sf_dir, **lookups)
    return wide.select(*[name for name in TRANSACTION_COLUMNS if name in wide.columns])


def with_card(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Bank and card type of transactions, by the order in their id."""
    key = F.floor(F.substring("transaction_id", 4, 20).cast("long") / 10)
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    held = orders.select(
        F.col("o_orderkey").alias("_order"),
        _bank(digit).alias("bank_name"),
        _card_type(F.col("o_custkey"), digit).alias("card_type"),
    )
    return rows.join(held, key == F.col("_order"), "left").drop("_order")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    balance = money(F.col("c_acctbal"))
    return (
        table(spark, sf_dir, "customer")
        .join(
            _places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        .select(
            customer_id(key).alias("customer_id"),
            F.col("c_name").alias("first_name"),
            F.concat(F.lit("Family"), key % 1000).alias("last_name"),
            F.when(key % 2 == 0, "Male").otherwise("Female").alias("gender"),
            (18 + key % 53).cast("int").alias("age"),
            F.concat(F.lit("customer"), key, F.lit("@example.com")).alias("email"),
            identifier("", key, 10).alias("phone"),
            "city",
            "state",
            F.col("c_mktsegment").alias("occupation"),
            money(F.lit(300000) + (balance + 1000) * 245).alias("annual_income"),
            F.date_add(F.lit("2023-10-08").cast("date"), (key % 1095).cast("int")).alias(
                "registration_date"
            ),
            balance.alias("balance"),
        )
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per owner and order priority that occurs."""
    key, digit = F.col("o_custkey"), F.col("digit")
    status = (
        F.when((key + digit) % 3 == 0, "Active")
        .when((key + digit) % 3 == 1, "Blocked")
        .otherwise("Expired")
    )
    held = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("digit"))
        .distinct()
    )
    issue = F.date_add(
        F.lit("2023-10-08").cast("date"), ((key * 5 + digit) % 1095).cast("int")
    )
    expiry = F.date_add(
        F.lit("2027-10-07").cast("date"), ((key * 3 + digit) % 1825).cast("int")
    )
    return held.select(
        card_id(key, digit).alias("card_id"),
        customer_id(key).alias("customer_id"),
        _card_type(key, digit).alias("card_type"),
        _bank(digit).alias("bank_name"),
        F.lit("Visa").alias("card_network"),
        issue.alias("issue_date"),
        expiry.alias("expiry_date"),
        status.alias("card_status"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(
            _places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"), "left"
        )
        .select(
            merchant_id(key).alias("merchant_id"),
            F.col("s_name").alias("merchant_name"),
            _category(key).alias("merchant_category"),
            "city",
            "state",
            F.concat(F.lit("Contact "), key).alias("contact_person"),
            F.concat(F.lit("merchant"), key, F.lit("@example.com")).alias("email"),
            identifier("", key, 10).alias("phone"),
            F.date_add(F.lit("2021-10-08").cast("date"), (key % 1825).cast("int")).alias(
                "registration_date"
            ),
            _nth(key % 3, model.MERCHANT_STATUSES).alias("merchant_status"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def clean_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "customers": customers(spark, sf_dir).drop("balance"),
        "cards": cards(spark, sf_dir),
        "merchants": merchants(spark, sf_dir).drop("balance"),
        "transactions": full_transactions(spark, sf_dir),
    }


def damaged_tables(
    spark: SparkSession, sf_dir: str, **lookups: bool
) -> dict[str, DataFrame]:
    """The same tables as a careless sender might deliver them.

    Uncleaned transactions with copies and the requested lookups, merchants in
    debt left out, one bank's cards missing, and bad values wherever a source
    column says so.
    """
    owners = customers(spark, sf_dir)
    in_debt = F.col("balance") < 0
    owners = owners.withColumns(
        {
            "age": F.when(in_debt, F.lit(17)).otherwise(F.col("age")),
            "annual_income": F.when(F.col("balance") >= 9500, "inf").otherwise(
                F.col("annual_income").cast("string")
            ),
            "registration_date": F.when(
                in_debt & (F.col("occupation") == "BUILDING"), "not-a-date"
            ).otherwise(F.col("registration_date").cast("string")),
        }
    )
    expired = F.col("card_status") == "Expired"
    held = (
        cards(spark, sf_dir)
        .where(F.col("bank_name") != model.BANKS[4])
        .withColumns(
            {
                "issue_date": F.when(
                    expired & (F.col("card_type") == "Credit"),
                    F.lit("2026-10-08").cast("date"),
                ).otherwise(F.col("issue_date")),
                "expiry_date": F.when(
                    expired, F.lit("2026-10-06").cast("date")
                ).otherwise(F.col("expiry_date")),
            }
        )
    )
    shops = (
        merchants(spark, sf_dir)
        .where(F.col("balance") >= 0)
        .withColumns(
            {
                "merchant_category": F.when(
                    F.col("balance") > 9000, "Unknown"
                ).otherwise(F.col("merchant_category")),
                "merchant_status": F.when(F.col("balance") > 8000, "   ").otherwise(
                    F.col("merchant_status")
                ),
            }
        )
    )
    method = F.col("payment_method")
    sent = raw_transactions(spark, sf_dir, **lookups).withColumns(
        {
            "amount": F.when(F.col("amount") > 100000, F.lit(float("inf")))
            .when(F.col("amount") < 1000, F.lit(0.0))
            .otherwise(F.col("amount")),
            "transaction_date": F.when(
                (method == "EMV") & (F.col("transaction_type") == "Refund"),
                "not-a-date",
            )
            .when((method == "Online") & (F.col("transaction_type") == "Refund"), "2026-10-08")
            .otherwise(F.col("transaction_date").cast("string")),
            "transaction_status": F.when(
                F.col("transaction_status") == "Disputed", "Unknown"
            ).otherwise(F.col("transaction_status")),
        }
    )
    return {
        "customers": owners.drop("balance"),
        "cards": held,
        "merchants": shops.drop("balance"),
        "transactions": sent,
    }


def text_snapshot(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """The nine safe columns with all values as text, as a file holds them.

    With ``damaged`` each checked column has values that a snapshot rejects.
    """
    tx = transactions(spark, sf_dir, card=True, merchant=True).select(
        *model.SAFE_COLUMNS
    )
    status, category = F.col("transaction_status"), F.col("merchant_category")
    texts = {
        "amount": F.concat(F.lit(" "), F.col("amount").cast("string")),
        "is_successful": F.when(F.col("is_successful"), " TRUE").otherwise("0"),
        "is_failure": F.when(F.col("is_failure"), "1").otherwise("False "),
    }
    tx = tx.withColumns(texts)
    if not damaged:
        return tx
    return tx.withColumns(
        {
            "amount": F.when(category == "Grocery", "1,000")
            .when(category == "Travel", "inf")
            .otherwise(F.col("amount")),
            "transaction_status": F.when(status == "Disputed", " \t")
            .when(status == "Refunded", None)
            .otherwise(status),
            "transaction_month": F.when(
                category == "Retail", F.translate("transaction_month", "-", "/")
            ).otherwise(F.col("transaction_month")),
            "is_successful": F.when(status == "Pending", "unknown").otherwise(
                F.col("is_successful")
            ),
            "is_failure": F.when(status == "Failed", None).otherwise(
                F.col("is_failure")
            ),
        }
    )
