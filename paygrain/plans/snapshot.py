"""The aggregate snapshot that questions are answered from.

``rows`` is always the output of ``cleaning.snapshot_rows``. Null names stay as
a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain import model
from paygrain.functions.values import ratio
from paygrain.operators import measures as m


def overall(rows: DataFrame) -> DataFrame:
    """One row, built from per-currency counters."""
    by_currency = rows.groupBy("currency").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_successful").alias("done"),
        F.count_if("is_failed_status").alias("failed"),
        F.sum(F.when(F.col("is_successful"), F.col("amount"))).alias("amount"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    done = F.coalesce(F.sum("done"), F.lit(0))
    prevailing = F.min(
        F.when(
            F.col("currency").isNotNull(),
            F.struct((-F.col("n")).alias("n"), "currency"),
        )
    ).getField("currency")
    return by_currency.agg(
        total.alias("total_transactions"),
        done.alias("completed_transactions"),
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias(
            "completed_amount"
        ),
        ratio(done, total).alias("success_rate"),
        F.coalesce(prevailing, F.lit(model.CURRENCY_FALLBACK)).alias("currency"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_transactions"),
    )


def currency(rows: DataFrame) -> Column:
    """The currency of most rows, as a scalar subquery."""
    return overall(rows).select("currency").scalar()


def banks(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("bank_name").alias("bank")).agg(
        m.rows(),
        m.tally("is_successful", "completed_transactions"),
        m.completed_amount(),
        m.share("is_successful", "success_rate"),
        m.tally("is_failed_status", "failed_transactions"),
    )


def merchants(rows: DataFrame) -> DataFrame:
    """By name and category: merchants that share both are one entry."""
    return rows.groupBy(
        F.col("merchant_name").alias("merchant"),
        F.col("merchant_category").alias("category"),
    ).agg(
        m.rows(),
        m.share("is_failure", "failure_rate"),
        m.completed_amount(),
        m.tally("is_failure", "failed_transactions"),
    )


def categories(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("merchant_category").alias("category")).agg(
        m.rows(),
        m.completed_amount(),
        m.tally("is_failure", "failed_transactions"),
        m.share("is_failure", "failure_rate"),
    )


def months(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("transaction_month").alias("month")).agg(
        m.rows(),
        m.tally("is_successful", "completed_transactions"),
        m.tally("is_failed_status", "failed_transactions"),
        m.completed_amount(),
    )


def all_grains(rows: DataFrame) -> DataFrame:
    """Overall, banks, merchants, categories and months in one pass.

    The fact is counted once per combination of its four dimensions; the five
    grains are grouping sets over those counts. Each grain carries the metrics
    it has and nulls for the others: success for overall, banks and months,
    failure rates for merchants and categories.
    """
    dims = ("bank_name", "merchant_name", "merchant_category", "transaction_month")
    counted = rows.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_successful").alias("done"),
        F.count_if("is_failed_status").alias("failed_status"),
        F.count_if("is_failure").alias("failed_flag"),
        F.sum(F.when(F.col("is_successful"), F.col("amount"))).alias("amount"),
    )
    bank, merchant, category, month = dims
    sets = [[bank], [merchant, category], [category], [month], []]
    grouped = counted.groupingSets(sets, *dims).agg(
        *[F.sum(name).alias(name) for name in ("n", "done", "failed_status")],
        F.sum("failed_flag").alias("failed_flag"),
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias(
            "completed_amount"
        ),
        *[(F.grouping(dim) == 0).alias(f"by_{dim}") for dim in dims],
    )
    grain = (
        F.when(F.col(f"by_{bank}"), "bank")
        .when(F.col(f"by_{merchant}"), "merchant")
        .when(F.col(f"by_{category}"), "category")
        .when(F.col(f"by_{month}"), "month")
        .otherwise("overall")
    )
    by_flag = F.col("grain").isin("merchant", "category")
    name = (
        F.when(F.col("grain") == "bank", F.col(bank))
        .when(F.col("grain") == "merchant", F.col(merchant))
        .when(F.col("grain") == "category", F.col(category))
        .when(F.col("grain") == "month", F.col(month))
    )
    return grouped.withColumn("grain", grain).select(
        "grain",
        name.alias("name"),
        F.when(F.col("grain") == "merchant", F.col(category)).alias("category"),
        F.col("n").alias("transaction_count"),
        F.when(~by_flag, F.col("done")).alias("completed_transactions"),
        "completed_amount",
        F.when(
            F.col("grain").isin("bank", "overall"), ratio(F.col("done"), F.col("n"))
        ).alias("success_rate"),
        F.when(by_flag, F.col("failed_flag"))
        .otherwise(F.col("failed_status"))
        .alias("failed_transactions"),
        F.when(by_flag, ratio(F.col("failed_flag"), F.col("n"))).alias("failure_rate"),
    )
