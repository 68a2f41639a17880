"""Joins between the fact and its dimensions.

No join carries a broadcast hint: Spark broadcasts a dimension while its
measured size is below the session's threshold and sorts and merges otherwise,
splitting skewed fact partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owned_cards(cards: DataFrame, customers: DataFrame) -> DataFrame:
    """Cards with their customer's place; cards without a customer are skipped."""
    places = customers.select(
        "customer_id",
        F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    return cards.join(places, "customer_id")


def with_merchant(df: DataFrame, merchants: DataFrame) -> DataFrame:
    """Copy the merchant's attributes onto rows that name a merchant.

    A left join: of the two sides only the merchants may ever be broadcast.
    """
    attributes = merchants.select(
        "merchant_id",
        "merchant_name",
        "merchant_category",
        F.col("city").alias("merchant_city"),
        F.col("state").alias("merchant_state"),
    )
    return df.join(attributes, "merchant_id", "left")


def star(
    tx: DataFrame, customers: DataFrame, cards: DataFrame, merchants: DataFrame
) -> DataFrame:
    """The fact with attributes of its three dimensions; fact rows all stay."""
    return (
        tx.join(
            customers.select("customer_id", "gender", "age", "occupation"),
            "customer_id",
            "left",
        )
        .join(
            cards.select("card_id", "card_network", "card_status"), "card_id", "left"
        )
        .join(merchants.select("merchant_id", "merchant_status"), "merchant_id", "left")
    )
