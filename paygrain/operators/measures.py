"""Aggregate expressions and the two generic aggregates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.functions.values import ratio



def rows(name: str = "transaction_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def ids(name: str = "transaction_count") -> Column:
    """Rows that carry a transaction id."""
    return F.count("transaction_id").alias(name)


def total(name: str = "total_amount") -> Column:
    return _sum(F.col("amount")).alias(name)


def completed_amount(name: str = "completed_amount") -> Column:
    return _sum(F.when(F.col("is_successful"), F.col("amount"))).alias(name)


def tally(flag: str, name: str) -> Column:
    return F.count_if(F.col(flag)).alias(name)


def share(flag: str, name: str) -> Column:
    """Fraction of rows with the flag set; null for an empty group."""
    return _share(flag).alias(name)


def share_or_zero(flag: str, name: str) -> Column:
    return F.coalesce(_share(flag), F.lit(0.0)).alias(name)


def percent(flag: str, name: str) -> Column:
    return F.round(100 * _share(flag), 2).alias(name)


def customers(name: str = "active_customers") -> Column:
    return F.countDistinct("customer_id").alias(name)


def average(name: str) -> Column:
    """Mean amount, from the exact decimal sum."""
    return (
        F.sum("amount").cast("double") / F.count("amount").cast("double")
    ).alias(name)


def _sum(amount: Column) -> Column:
    # Summed as decimal, so no binary noise; double only in the result.
    return F.coalesce(F.sum(amount).cast("double"), F.lit(0.0))


def _share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def measures(tx: DataFrame, *dims: str) -> DataFrame:
    """The eight report measures per combination of ``dims`` (or overall).

    Slicers are filters on ``tx`` before the call. Status decides success and
    failure here, not the flags.
    """
    done = F.col("transaction_status") == "Completed"
    failed = F.col("transaction_status") == "Failed"
    grouped = tx.groupBy(*dims).agg(
        _sum(F.when(done, F.col("amount"))).alias("completed_amount"),
        rows(),
        customers(),
        F.count_if(done).alias("successful_transactions"),
        F.count_if(failed).alias("failed_transactions"),
    )
    count = F.col("transaction_count")
    return grouped.select(
        *dims,
        "completed_amount",
        "transaction_count",
        "active_customers",
        "successful_transactions",
        ratio(F.col("successful_transactions"), count).alias("success_rate"),
        "failed_transactions",
        ratio(F.col("failed_transactions"), count).alias("failure_rate"),
        ratio(F.col("completed_amount"), F.col("successful_transactions")).alias(
            "average_completed_ticket"
        ),
    )


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value, the smallest one on a tie.

    Counts per value first, so the number of distinct values does not matter.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return counted.agg(
        F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("value")))
        .getField("value")
        .alias(column)
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [
        df.agg(rows("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result


def spread(df: DataFrame, column: str) -> DataFrame:
    """Mean and sample standard deviation as doubles, one row."""
    value = F.col(column).cast("double")
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
