"""Counters from which all written reports follow, and which add up.

``rollup`` reads the fact once and counts it per customer, merchant, month,
category and status, and overall. Rollups of separate sets of transactions are
simply stacked; ``merged`` adds them up. The reports below give exactly what
the functions of the same name in ``plans.reports`` give on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.plans.reports import MERCHANT

KEYS = (
    "customer_id",
    *MERCHANT,
    "transaction_month",
    "transaction_status",
)
GRAINS = {
    "customer": ("customer_id",),
    "merchant": MERCHANT,
    "month": ("transaction_month",),
    "category": ("merchant_category",),
    "status": ("transaction_status",),
    "overall": (),
}
SUMS = (
    "row_count",
    "id_count",
    "amount",
    "squares",
    "done_rows",
    "done_ids",
    "done_amount",
    "failed",
)


def rollup(tx: DataFrame) -> DataFrame:
    """One row of sums per grain and key, nulls as keys of their own."""
    done, amount = F.col("is_successful"), F.col("amount")
    grouped = tx.groupingSets([list(keys) for keys in GRAINS.values()], *KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("transaction_id").alias("id_count"),
        F.sum("amount").alias("amount"),
        F.sum(amount * amount).alias("squares"),
        F.count_if(done).alias("done_rows"),
        F.count(F.when(done, F.col("transaction_id"))).alias("done_ids"),
        F.sum(F.when(done, amount)).alias("done_amount"),
        F.count_if("is_failure").alias("failed"),
        *[(F.grouping(key) == 0).alias(f"by_{key}") for key in KEYS],
    )
    grain = (
        F.when(F.col("by_customer_id"), "customer")
        .when(F.col("by_merchant_id"), "merchant")
        .when(F.col("by_transaction_month"), "month")
        .when(F.col("by_merchant_category"), "category")
        .when(F.col("by_transaction_status"), "status")
        .otherwise("overall")
    )
    return grouped.select(
        grain.alias("grain"),
        *KEYS,
        *[_sized(name).alias(name) for name in SUMS],
    )


def _sized(name: str) -> Column:
    """Fixed widths, so that stacked rollups keep one schema."""
    widths = {"amount": 2, "done_amount": 2, "squares": 4}
    if name in widths:
        return F.coalesce(F.col(name), F.lit(0)).cast(f"decimal(38,{widths[name]})")
    return F.col(name).cast("long")


def merged(rollups: DataFrame) -> DataFrame:
    return rollups.groupBy("grain", *KEYS).agg(
        *[F.sum(name).alias(name) for name in SUMS]
    )


def _grain(totals: DataFrame, grain: str) -> DataFrame:
    rows = totals.where(F.col("grain") == grain)
    for key in GRAINS[grain]:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def _money(name: str) -> Column:
    return F.col(name).cast("double")


def _failure_rate() -> Column:
    return F.col("failed").cast("double") / F.col("row_count").cast("double")


def customer_summary(totals: DataFrame) -> DataFrame:
    return (
        _grain(totals, "customer")
        .where(F.col("done_rows") > 0)
        .select(
            "customer_id",
            F.col("done_ids").alias("successful_transactions"),
            _money("done_amount").alias("successful_spend"),
            (_money("done_amount") / F.col("done_rows").cast("double")).alias(
                "average_transaction_value"
            ),
        )
    )


def merchant_summary(totals: DataFrame) -> DataFrame:
    return (
        _grain(totals, "merchant")
        .select(
            *MERCHANT,
            F.col("id_count").alias("transaction_count"),
            _money("amount").alias("total_amount"),
            _money("done_amount").alias("completed_amount"),
            F.col("failed").alias("failed_transactions"),
        )
        .orderBy(F.desc("completed_amount"), *MERCHANT)
    )


def monthly_performance(totals: DataFrame) -> DataFrame:
    return (
        _grain(totals, "month")
        .select(
            "transaction_month",
            F.col("id_count").alias("transaction_count"),
            _money("done_amount").alias("completed_amount"),
            _failure_rate().alias("failure_rate"),
        )
        .orderBy("transaction_month")
    )


def category_performance(totals: DataFrame) -> DataFrame:
    return (
        _grain(totals, "category")
        .select(
            "merchant_category",
            F.col("id_count").alias("transaction_count"),
            _money("amount").alias("total_amount"),
            _money("done_amount").alias("completed_amount"),
            _failure_rate().alias("failure_rate"),
        )
        .orderBy(F.desc("completed_amount"), "merchant_category")
    )


def status_distribution(totals: DataFrame) -> DataFrame:
    return (
        _grain(totals, "status")
        .select(
            F.col("transaction_status").alias("status"),
            F.col("row_count").alias("transaction_count"),
        )
        .orderBy(F.desc("transaction_count"), "status")
    )


def amount_spread(totals: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the amounts, from exact sums."""
    rows = totals.where(F.col("grain") == "overall").agg(
        *[F.sum(name).cast("double").alias(name) for name in ("row_count", "amount", "squares")]
    )
    count, amount = F.col("row_count"), F.col("amount")
    variance = F.try_divide(
        F.col("squares") - F.try_divide(amount * amount, count), count - 1
    )
    return rows.select(
        F.try_divide(amount, count).alias("mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
    )


REPORTS = {
    "customer_summary": customer_summary,
    "merchant_summary": merchant_summary,
    "monthly_performance": monthly_performance,
    "category_performance": category_performance,
    "status_distribution": status_distribution,
}
