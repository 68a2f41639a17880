"""The published reports. Each takes the cleaned fact and returns one table.

Reports written against files and the listing service ignore null keys; the
SQL reports keep them as a group. Ties are broken by the key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paygrain import model
from paygrain.operators import filters
from paygrain.operators import measures as m

MERCHANT = ("merchant_id", "merchant_name", "merchant_category")


def _known(tx: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        tx = tx.where(F.col(key).isNotNull())
    return tx


# --- summary tables and reports written by the pipeline -------------------


def customer_summary(tx: DataFrame) -> DataFrame:
    return (
        _known(filters.completed(tx), "customer_id")
        .groupBy("customer_id")
        .agg(
            m.ids("successful_transactions"),
            m.total("successful_spend"),
            m.average("average_transaction_value"),
        )
    )


def merchant_summary(tx: DataFrame) -> DataFrame:
    return (
        _known(tx, *MERCHANT)
        .groupBy(*MERCHANT)
        .agg(
            m.ids(),
            m.total(),
            m.completed_amount(),
            m.tally("is_failure", "failed_transactions"),
        )
        .orderBy(F.desc("completed_amount"), *MERCHANT)
    )


def monthly_performance(tx: DataFrame) -> DataFrame:
    return (
        _known(tx, "transaction_month")
        .groupBy("transaction_month")
        .agg(m.ids(), m.completed_amount(), m.share("is_failure", "failure_rate"))
        .orderBy("transaction_month")
    )


def category_performance(tx: DataFrame) -> DataFrame:
    return (
        _known(tx, "merchant_category")
        .groupBy("merchant_category")
        .agg(
            m.ids(),
            m.total(),
            m.completed_amount(),
            m.share("is_failure", "failure_rate"),
        )
        .orderBy(F.desc("completed_amount"), "merchant_category")
    )


def status_distribution(tx: DataFrame) -> DataFrame:
    return (
        _known(tx, "transaction_status")
        .groupBy(F.col("transaction_status").alias("status"))
        .agg(m.rows())
        .orderBy(F.desc("transaction_count"), "status")
    )


# --- business queries -----------------------------------------------------


def kpi(tx: DataFrame) -> DataFrame:
    return tx.agg(
        m.completed_amount(),
        m.rows("total_transactions"),
        m.customers(),
        m.percent("is_successful", "success_rate_pct"),
    )


def monthly_trend(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("transaction_month")
        .agg(m.rows(), m.completed_amount())
        .orderBy("transaction_month")
    )


def category_kpi(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("merchant_category")
        .agg(
            m.rows(), m.completed_amount(), m.percent("is_failure", "failure_rate_pct")
        )
        .orderBy(F.desc("completed_amount"), "merchant_category")
    )


def top_customers(tx: DataFrame, limit: int = 10) -> DataFrame:
    return (
        filters.completed(tx)
        .groupBy("customer_id")
        .agg(
            m.rows("completed_transactions"),
            m.total("completed_spend"),
            m.average("average_ticket"),
        )
        .orderBy(F.desc("completed_spend"), "customer_id")
        .limit(limit)
    )


def merchant_risk(tx: DataFrame, min_count: int = 5) -> DataFrame:
    """Merchants of some volume that fail more often than the whole table.

    The overall rate is the rate over the merchant groups. Both sides use the
    same two counters, so Spark runs one aggregation and reuses its shuffle.
    """
    grouped = tx.groupBy(*MERCHANT).agg(m.rows(), m.tally("is_failure", "failed"))
    overall = grouped.select(
        F.sum("failed").cast("double") / F.sum("transaction_count").cast("double")
    ).scalar()
    rate = F.col("failed").cast("double") / F.col("transaction_count").cast("double")
    return (
        grouped.where((F.col("transaction_count") >= min_count) & (rate > overall))
        .select(
            *MERCHANT,
            "transaction_count",
            F.round(100 * rate, 2).alias("failure_rate_pct"),
        )
        .orderBy(
            F.desc("failure_rate_pct"), F.desc("transaction_count"), *MERCHANT
        )
    )


def bank_card_mix(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("bank_name", "card_type")
        .agg(
            m.rows(),
            m.completed_amount(),
            m.percent("is_successful", "success_rate_pct"),
        )
        .orderBy(F.desc("completed_amount"), "bank_name", "card_type")
    )


# --- listing service ------------------------------------------------------


def service_summary(tx: DataFrame) -> DataFrame:
    """Overall figures, distinct customers and the prevailing currency.

    One pass: the fact collapses to (customer, currency) before the two
    rollups, so neither the distinct count nor the currency histogram ever
    sees a raw row, and nothing but counters reaches the last step.
    """
    pairs = tx.groupBy("customer_id", "currency").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_successful").alias("done"),
        F.sum(F.when(F.col("is_successful"), F.col("amount"))).alias("amount"),
    )
    by_customer, by_currency = F.grouping("currency") == 1, F.grouping("customer_id") == 1
    rolled = pairs.groupingSets(
        [["customer_id"], ["currency"]], "customer_id", "currency"
    ).agg(
        F.sum("n").alias("n"),
        F.sum("done").alias("done"),
        F.sum("amount").alias("amount"),
        by_customer.alias("is_customer"),
        by_currency.alias("is_currency"),
    )
    mine = F.col("is_customer")
    total = F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0))
    done = F.coalesce(F.sum(F.when(mine, F.col("done"))), F.lit(0))
    prevailing = F.min(
        F.when(
            F.col("is_currency") & F.col("currency").isNotNull(),
            F.struct((-F.col("n")).alias("n"), "currency"),
        )
    ).getField("currency")
    return rolled.agg(
        total.alias("total_transactions"),
        done.alias("completed_transactions"),
        F.coalesce(
            F.sum(F.when(mine, F.col("amount"))).cast("double"), F.lit(0.0)
        ).alias("completed_amount"),
        F.coalesce(
            F.try_divide(done.cast("double"), total.cast("double")), F.lit(0.0)
        ).alias("success_rate"),
        F.count_if(mine & F.col("customer_id").isNotNull()).alias("active_customers"),
        F.coalesce(prevailing, F.lit(model.CURRENCY_FALLBACK)).alias("currency"),
    )


def service_categories(tx: DataFrame) -> DataFrame:
    return (
        _known(tx, "merchant_category")
        .groupBy(F.col("merchant_category").alias("category"))
        .agg(m.rows(), m.completed_amount())
        .orderBy("category")
    )


def service_banks(tx: DataFrame) -> DataFrame:
    return (
        _known(tx, "bank_name")
        .groupBy("bank_name")
        .agg(
            m.rows(),
            m.tally("is_successful", "completed_transactions"),
            m.completed_amount(),
        )
        .orderBy("bank_name")
    )


def service_merchants(tx: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return (
        _known(tx, *MERCHANT)
        .groupBy(*MERCHANT)
        .agg(m.rows(), m.share("is_failure", "failure_rate"), m.completed_amount())
        .orderBy(F.desc("completed_amount"), *MERCHANT)
        .limit(limit)
    )


# --- dashboard ------------------------------------------------------------


def dashboard_kpi(tx: DataFrame, categories: Iterable[str], **chosen) -> DataFrame:
    """KPI tiles of a selection; all zero until a category is chosen."""
    categories = list(categories)
    selected = filters.filter_in(
        filters.category_gate(tx, categories), categories, **chosen
    )
    return selected.agg(
        m.completed_amount(),
        m.rows("transactions"),
        m.customers(),
        m.share_or_zero("is_successful", "success_rate"),
    )


def dashboard_monthly(tx: DataFrame) -> DataFrame:
    """Month taken from the date again, not from the stored text."""
    return (
        tx.where(F.col("transaction_date").isNotNull())
        .groupBy(
            F.date_format("transaction_date", "yyyy-MM").alias("transaction_month")
        )
        .agg(m.completed_amount(), m.ids("transactions"))
        .orderBy("transaction_month")
    )


def dashboard_categories(tx: DataFrame) -> DataFrame:
    return (
        _known(filters.completed(tx), "merchant_category")
        .groupBy("merchant_category")
        .agg(m.total("completed_amount"))
        .orderBy("completed_amount", "merchant_category")
    )


def bank_card_pivot(tx: DataFrame) -> DataFrame:
    """Completed amount, banks by card type, gaps as zero."""
    return (
        _known(filters.completed(tx), "bank_name", "card_type")
        .groupBy("bank_name")
        .pivot("card_type", sorted(model.CARD_TYPES))
        .agg(F.sum("amount").cast("double"))
        .fillna(0.0)
        .orderBy("bank_name")
    )


def dashboard_customers(tx: DataFrame, limit: int = 10) -> DataFrame:
    return (
        _known(filters.completed(tx), "customer_id")
        .groupBy("customer_id")
        .agg(m.total("completed_spend"), m.ids("transactions"))
        .orderBy(F.desc("completed_spend"), "customer_id")
        .limit(limit)
    )


def dashboard_failing_merchants(
    tx: DataFrame, limit: int = 10, min_count: int = 5, as_text: bool = False
) -> DataFrame:
    worst = (
        _known(tx, *MERCHANT)
        .groupBy(*MERCHANT)
        .agg(
            m.ids("transactions"),
            m.share("is_failure", "failure_rate"),
            m.total("total_amount"),
        )
        .where(F.col("transactions") >= min_count)
        .orderBy(F.desc("failure_rate"), *MERCHANT)
        .limit(limit)
    )
    if as_text:
        worst = worst.withColumn(
            "failure_rate", F.format_string("%.1f%%", F.col("failure_rate") * 100)
        )
    return worst


# --- document-style pipelines ---------------------------------------------


def document_monthly(tx: DataFrame) -> DataFrame:
    return (
        tx.where(F.col("transaction_status") == "Completed")
        .groupBy("transaction_month")
        .agg(m.total("completed_amount"), m.rows())
        .orderBy("transaction_month")
    )


def document_categories(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("merchant_category")
        .agg(
            m.rows("transactions"),
            F.count_if(F.col("transaction_status") == "Failed").alias("failed"),
            m.total("amount"),
        )
        .orderBy(F.desc("amount"), "merchant_category")
    )


def document_customers(tx: DataFrame, limit: int = 10) -> DataFrame:
    """Biggest spenders with the set of categories they bought from.

    Rows collapse to (customer, category) first, so the set of a customer is
    built from distinct categories and never from its raw transactions.
    """
    return (
        tx.where(F.col("transaction_status") == "Completed")
        .groupBy("customer_id", "merchant_category")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
        .groupBy("customer_id")
        .agg(
            F.sum("amount").cast("double").alias("completed_spend"),
            F.sum("n").alias("transactions"),
            F.sort_array(F.collect_set("merchant_category")).alias("categories"),
        )
        .orderBy(F.desc("completed_spend"), "customer_id")
        .limit(limit)
    )
