"""From raw transaction rows to the analysed fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrain import model
from paygrain.functions import values


def keep_first(
    df: DataFrame, key: Sequence[str], order_by: Sequence[Column | str]
) -> DataFrame:
    """One row per key: the first in the given order.

    A row-number filter lets Spark put a group limit in front of the shuffle,
    so each input partition sends at most one row per key and a key that holds
    a large part of the table costs no more than any other.
    """
    window = Window.partitionBy(*key).orderBy(*order_by)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def first_copies(
    raw: DataFrame, key: Sequence[str], keep_first_by: Sequence[Column | str]
) -> DataFrame:
    """Typed rows, the first per key. An unreadable date fails the job."""
    amount = values.number(F.col("amount"), raw.schema["amount"].dataType)
    typed = raw.withColumns(
        {
            "transaction_date": values.day(F.col("transaction_date")),
            "amount": amount,
        }
    )
    return keep_first(typed, key, keep_first_by)


def valid_amounts(first: DataFrame) -> DataFrame:
    """Rows with a positive finite amount, as exact money."""
    return first.where(values.positive_finite(F.col("amount"))).withColumn(
        "amount", values.money(F.col("amount"))
    )


def first_valid(
    raw: DataFrame, key: Sequence[str], keep_first_by: Sequence[Column | str]
) -> DataFrame:
    """Duplicates go before the amount check.

    When the first copy of an id is invalid, the id disappears.
    """
    return valid_amounts(first_copies(raw, key, keep_first_by))


def clean_transactions(
    raw: DataFrame,
    keep_first_by: Sequence[Column | str],
    key: Sequence[str] = ("transaction_id",),
) -> DataFrame:
    """Typed, deduplicated, positive-amount transactions with derived columns."""
    return with_derived(first_valid(raw, key, keep_first_by))


def with_derived(df: DataFrame) -> DataFrame:
    """Add month text and the two exact-match status flags."""
    status = F.col("transaction_status")
    return df.withColumns(
        {
            "transaction_month": values.month(F.col("transaction_date")),
            "is_successful": F.coalesce(status == "Completed", F.lit(False)),
            "is_failure": F.coalesce(status == "Failed", F.lit(False)),
        }
    )


def public_cards(cards: DataFrame) -> DataFrame:
    """Cards without number and verification code, whether or not present."""
    return cards.drop(*model.CARD_SECRETS)


def without_contacts(merchants: DataFrame) -> DataFrame:
    return merchants.drop(*model.MERCHANT_CONTACTS)


def snapshot_rows(tx: DataFrame) -> DataFrame:
    """The nine safe columns of a snapshot; one bad value rejects all of it.

    Every row passes a gate over all checks, whatever columns a report reads,
    so the first bad row fails the job. The gate has a part that Spark takes
    for non-deterministic: filters of a report stay above it, and no row is
    skipped unchecked. It needs no pass of its own.
    """
    missing = sorted(set(model.SAFE_COLUMNS) - set(tx.columns))
    if missing:
        raise ValueError("missing analytics columns: " + ", ".join(missing))
    kinds = {name: tx.schema[name].dataType for name in model.SAFE_COLUMNS}
    problem = F.coalesce(
        *[
            F.when(~holds, F.lit(f"invalid {CHECKED.get(name, f'{name} values')}"))
            for name, holds in _snapshot_checks(tx).items()
        ]
    )
    passed = F.when(
        problem.isNull(), F.monotonically_increasing_id() >= 0
    ).otherwise(F.raise_error(problem).cast("boolean"))
    return tx.where(passed).select(
        "merchant_category",
        "merchant_name",
        "currency",
        "bank_name",
        F.col("amount").cast(model.MONEY).alias("amount"),
        values.strip(F.col("transaction_status")).alias("transaction_status"),
        values.strip(F.col("transaction_month")).alias("transaction_month"),
        *[
            values.flag(F.col(name), kinds[name], name).alias(name)
            for name in ("is_successful", "is_failure")
        ],
    ).withColumn(
        "is_failed_status",
        values.casefold(F.col("transaction_status")) == "failed",
    )


# How a message names the values of a column, where not by the column itself.
CHECKED = {
    "amount": "amounts",
    "transaction_status": "statuses",
    "transaction_month": "transaction months",
}


def _snapshot_checks(tx: DataFrame) -> dict[str, Column]:
    """What must hold for each checked column, never null."""
    kinds = {field.name: field.dataType for field in tx.schema.fields}
    holds = {
        "amount": values.positive_finite(values.number(F.col("amount"), kinds["amount"])),
        "transaction_status": values.strip(F.col("transaction_status")) != "",
        "transaction_month": values.strip(F.col("transaction_month")).rlike(
            r"^\d{4}-\d{2}$"
        ),
    }
    for name in ("is_successful", "is_failure"):
        if kinds[name].typeName() != "boolean":
            text = F.lower(values.strip(F.col(name).cast("string")))
            holds[name] = text.isin("true", "false", "1", "0")
    return {name: F.coalesce(test, F.lit(False)) for name, test in holds.items()}


def snapshot_violations(tx: DataFrame) -> DataFrame:
    """Counts of the rows each snapshot check would reject, in one pass."""
    holds = _snapshot_checks(tx)
    counted = tx.agg(*[F.count_if(~test).alias(name) for name, test in holds.items()])
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"), F.col(name).alias("violations")
                    )
                    for name in holds
                ]
            )
        )
    )
