"""Small payments tables with known results."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import SparkSession

VALID = {
    "customers": (
        "customer_id string, age int, annual_income decimal(12,2), "
        "registration_date string",
        [("C1", 30, Decimal("500000"), "2025-01-01")],
    ),
    "cards": (
        "card_id string, customer_id string, card_status string, "
        "issue_date string, expiry_date string",
        [("CARD1", "C1", "Active", "2024-01-01", "2028-01-01")],
    ),
    "merchants": (
        "merchant_id string, merchant_category string, merchant_status string, "
        "registration_date string",
        [("M1", "Retail", "Active", "2024-01-01")],
    ),
    "transactions": (
        "transaction_id string, card_id string, customer_id string, "
        "merchant_id string, amount double, transaction_date string, "
        "transaction_status string, merchant_category string",
        [("T1", "CARD1", "C1", "M1", 25.0, "2025-01-02", "Completed", "Retail")],
    ),
}


def valid_tables(spark: SparkSession, **changes):
    """The valid set; ``table__column=value`` replaces a value of its one row."""
    tables = {}
    for name, (schema, data) in VALID.items():
        columns = [part.split()[0] for part in schema.split(", ")]
        row = dict(zip(columns, data[0]))
        for key, value in changes.items():
            table, _, column = key.partition("__")
            if table == name:
                row[column] = value
                if isinstance(value, str):
                    kinds = dict(part.split() for part in schema.split(", "))
                    if kinds[column] != "string":
                        schema = schema.replace(
                            f"{column} {kinds[column]}", f"{column} string"
                        )
                elif column == "annual_income":
                    schema = schema.replace("decimal(12,2)", "double")
        tables[name] = spark.createDataFrame([tuple(row[c] for c in columns)], schema)
    return tables


SERVED_SCHEMA = (
    "transaction_id string, customer_id string, card_id string, merchant_id string, "
    "merchant_name string, merchant_category string, transaction_date date, "
    "currency string, transaction_type string, transaction_status string, "
    "payment_method string, merchant_city string, merchant_state string, "
    "bank_name string, card_type string, amount decimal(12,2), "
    "transaction_month string, is_successful boolean, is_failure boolean, "
    "customer_city string, customer_state string, card_number string, cvv string"
)


def served_row(
    number, customer, merchant, name, category, amount, status, bank, card, **other
):
    row = {
        "transaction_id": f"T{number}",
        "customer_id": customer,
        "card_id": f"CARD{customer[1:]}" if customer else None,
        "merchant_id": merchant,
        "merchant_name": name,
        "merchant_category": category,
        "transaction_date": date(2026, 1, number),
        "currency": "INR",
        "transaction_type": "Purchase",
        "transaction_status": status,
        "payment_method": "Chip",
        "merchant_city": "Pune",
        "merchant_state": "Maharashtra",
        "bank_name": bank,
        "card_type": card,
        "amount": Decimal(str(amount)),
        "transaction_month": "2026-01",
        "is_successful": status == "Completed",
        "is_failure": status == "Failed",
        "customer_city": "Delhi",
        "customer_state": "Delhi",
        "card_number": "4111111111111111",
        "cvv": "123",
    }
    row.update(other)
    return tuple(row.values())


def served(spark: SparkSession, extra=()):
    data = [
        served_row(1, "C1", "M1", "Shop One", "Retail", 100, "Completed", "Example Bank", "Debit"),
        served_row(2, "C1", "M1", "Shop One", "Retail", 50, "Completed", "Example Bank", "Debit"),
        served_row(3, "C2", "M2", "Shop Two", "Grocery", 30, "Failed", "Another Bank", "Credit"),
    ]
    return spark.createDataFrame([*data, *extra], SERVED_SCHEMA)


def snapshot_source(spark: SparkSession):
    data = [
        served_row(1, "C1", "M1", "Shop One", "Retail", 100, "Completed", "Example Bank", "Debit"),
        served_row(2, "C1", "M1", "Shop One", "Retail", 50, "Failed", "Example Bank", "Debit"),
        served_row(
            3, "C2", "M2", "Shop Two", "Grocery", 75, "Completed", "Other Bank", "Credit",
            transaction_month="2026-02",
        ),
    ]
    return spark.createDataFrame(data, SERVED_SCHEMA)
