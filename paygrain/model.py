"""Schemas, value domains and column allowlists of the payments model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
CURRENCY_FALLBACK = "INR"
REFERENCE_DATE = date(2026, 10, 7)

# Columns a reader adds to a raw table: the place of a row in its files, and
# the text of a row that could not be taken apart.
FILE_ORDER = "_file_order"
MALFORMED = "_malformed"


def _struct(spec: str) -> T.StructType:
    """Build a schema from ``name:type`` pairs; a bare name is a string."""
    kinds = {
        "int": T.IntegerType(),
        "long": T.LongType(),
        "money": MONEY,
        "double": T.DoubleType(),
        "date": T.DateType(),
        "bool": T.BooleanType(),
        "": T.StringType(),
    }
    fields = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


CUSTOMERS = _struct(
    "customer_id first_name last_name gender age:int email phone city state "
    "occupation annual_income:money registration_date:date"
)
CARDS_PUBLIC = _struct(
    "card_id customer_id card_type bank_name card_network issue_date:date "
    "expiry_date:date card_status"
)
MERCHANTS = _struct(
    "merchant_id merchant_name merchant_category city state contact_person "
    "email phone registration_date:date merchant_status"
)
MERCHANTS_SQL = _struct(
    "merchant_id merchant_name merchant_category city state merchant_status "
    "registration_date:date"
)
TRANSACTIONS_CLEAN = _struct(
    "transaction_id card_id customer_id merchant_id merchant_name "
    "merchant_category transaction_date:date amount:money currency "
    "transaction_type transaction_status payment_method merchant_city "
    "merchant_state bank_name card_type customer_city customer_state "
    "description transaction_month is_successful:bool is_failure:bool"
)
CUSTOMER_SUMMARY = _struct(
    "customer_id successful_transactions:long successful_spend:double "
    "average_transaction_value:double"
)
MERCHANT_SUMMARY = _struct(
    "merchant_id merchant_name merchant_category transaction_count:long "
    "total_amount:double completed_amount:double failed_transactions:long"
)
KNOWLEDGE_BASE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
    ]
)

# Every table of the SQL model. Spark enforces no keys; see operators.quality.
TABLES = {
    "customers": CUSTOMERS,
    "cards_public": CARDS_PUBLIC,
    "merchants": MERCHANTS_SQL,
    "transactions_clean": TRANSACTIONS_CLEAN,
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "cards": "card_id",
    "merchants": "merchant_id",
    "transactions": "transaction_id",
}

# The domains, limits and column sets the results depend on.
CATEGORIES = (
    "Retail",
    "Electronics",
    "Grocery",
    "Restaurants",
    "Travel",
    "Health & Wellness",
    "Fashion",
    "Entertainment",
    "Education",
    "Online Services",
)
BANKS = (
    "HDFC Bank",
    "ICICI Bank",
    "State Bank of India",
    "Axis Bank",
    "Kotak Mahindra Bank",
)
CARD_TYPES = ("Debit", "Credit")
CARD_STATUSES = ("Active", "Blocked", "Expired")
MERCHANT_STATUSES = ("Active", "Pending", "Suspended")
TRANSACTION_STATUSES = ("Completed", "Pending", "Failed", "Refunded", "Disputed")
INCOME_RANGE = (300_000, 3_000_000)
AGE_RANGE = (18, 100)

REQUIRED_COLUMNS = {
    "customers": ("customer_id", "age", "annual_income", "registration_date"),
    "cards": ("card_id", "customer_id", "card_status", "issue_date", "expiry_date"),
    "merchants": (
        "merchant_id",
        "merchant_category",
        "merchant_status",
        "registration_date",
    ),
    "transactions": (
        "transaction_id",
        "card_id",
        "customer_id",
        "merchant_id",
        "amount",
        "transaction_date",
        "transaction_status",
        "merchant_category",
    ),
}
ALLOWED_VALUES = {
    "cards": {"card_status": CARD_STATUSES},
    "merchants": {
        "merchant_category": CATEGORIES,
        "merchant_status": MERCHANT_STATUSES,
    },
    "transactions": {
        "transaction_status": TRANSACTION_STATUSES,
        "merchant_category": CATEGORIES,
    },
}
DATE_COLUMNS = {
    "customers": ("registration_date",),
    "cards": ("issue_date", "expiry_date"),
    "merchants": ("registration_date",),
    "transactions": ("transaction_date",),
}
NOT_IN_FUTURE = {
    "customers": "registration_date",
    "cards": "issue_date",
    "merchants": "registration_date",
    "transactions": "transaction_date",
}

CARD_SECRETS = ("card_number", "cvv")
MERCHANT_CONTACTS = ("contact_person", "email", "phone")

# What a transaction listing may show: no customer or card identifiers.
RECORD_COLUMNS = (
    "transaction_id",
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
)
DISPLAY_COLUMNS = (
    "transaction_id",
    "merchant_name",
    "merchant_category",
    "transaction_date",
    "amount",
    "transaction_status",
    "payment_method",
    "merchant_city",
    "merchant_state",
    "bank_name",
    "card_type",
)
SAFE_COLUMNS = (
    "merchant_category",
    "merchant_name",
    "transaction_status",
    "transaction_month",
    "amount",
    "currency",
    "bank_name",
    "is_successful",
    "is_failure",
)
SERVED_COLUMNS = (
    *RECORD_COLUMNS,
    "customer_id",
    "is_successful",
    "is_failure",
)
