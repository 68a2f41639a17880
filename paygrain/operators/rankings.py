"""Comparison, ranking and lookup over the aggregate snapshot.

A metric a source does not provide stays null: it is reported as unavailable
and never turned into a number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain import model
from paygrain.operators.cleaning import keep_first

# Which aggregates can be ranked by what, and what breaks ties before the name.
BANK_METRICS = (
    "transaction_count",
    "completed_amount",
    "completed_transactions",
    "success_rate",
    "failed_transactions",
)
MERCHANT_METRICS = (
    "transaction_count",
    "completed_amount",
    "failed_transactions",
    "failure_rate",
)
CATEGORY_METRICS = MERCHANT_METRICS


def named(
    entities: DataFrame, entity: str, names: Iterable[str] | None = None
) -> DataFrame:
    """Rows of the named entities, any case; all rows when no names are given."""
    chosen = [name.lower() for name in names or ()]
    if not chosen:
        return entities
    return entities.where(F.lower(F.col(entity)).isin(chosen))


def compare(
    entities: DataFrame,
    entity: str,
    names: Iterable[str] | None = None,
    currency: Column | str = model.CURRENCY_FALLBACK,
) -> DataFrame:
    """Side-by-side metrics, with a failure rate wherever failures are known.

    ``currency`` is the one that prevails in the snapshot: ``snapshot.currency``.
    """
    rows = named(entities, entity, names)
    if "failure_rate" not in rows.columns:
        rows = rows.withColumn("failure_rate", failure_rate())
    given = F.lit(currency) if isinstance(currency, str) else currency
    return rows.withColumn("currency", given)


def failure_rate():
    """Null when failures were not measured, 0 when there was nothing to fail."""
    return F.when(
        F.col("failed_transactions").isNotNull(),
        F.coalesce(
            F.try_divide(
                F.col("failed_transactions").cast("double"),
                F.col("transaction_count").cast("double"),
            ),
            F.lit(0.0),
        ),
    )


def failures(
    entities: DataFrame, entity: str, names=None, then: Sequence[str] = ()
) -> DataFrame:
    """Failures by entity; ``then`` names what else tells its rows apart."""
    rows = named(entities, entity, names)
    return rows.select(
        entity,
        *then,
        "failed_transactions",
        "transaction_count",
        failure_rate().alias("failure_rate"),
    )


def overall_failures(overall: DataFrame) -> DataFrame:
    return overall.select(
        "failed_transactions",
        "total_transactions",
        F.when(
            F.col("failed_transactions").isNotNull(),
            F.coalesce(
                F.try_divide(
                    F.col("failed_transactions").cast("double"),
                    F.col("total_transactions").cast("double"),
                ),
                F.lit(0.0),
            ),
        ).alias("failure_rate"),
    )


def top_by_metric(
    entities: DataFrame,
    entity: str,
    metrics: Sequence[str],
    count_breaks_ties: Iterable[str] = (),
    then: Sequence[str] = (),
) -> DataFrame:
    """The leading entity for each metric.

    Larger value, then (for the listed metrics) larger count, then the larger
    name; ``then`` settles what is left. All metrics are ranked in one pass.
    """
    by_count = set(count_breaks_ties)
    candidates = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.col(metric).cast("double").alias("value"),
                (
                    F.col("transaction_count") if metric in by_count else F.lit(0)
                ).cast("long").alias("_tie"),
            )
            for metric in metrics
        ]
    )
    rows = entities.select(entity, *then, F.inline(candidates))
    best = keep_first(
        rows.where(F.col("value").isNotNull()),
        ["metric"],
        [F.desc("value"), F.desc("_tie"), F.desc(entity), *then],
    )
    return best.select("metric", entity, "value")


def top_banks(banks: DataFrame) -> DataFrame:
    return top_by_metric(
        banks,
        "bank",
        BANK_METRICS,
        count_breaks_ties=set(BANK_METRICS) - {"failed_transactions"},
    )


def top_merchants(merchants: DataFrame) -> DataFrame:
    return top_by_metric(
        merchants, "merchant", MERCHANT_METRICS, then=("category",)
    )


def top_categories(categories: DataFrame) -> DataFrame:
    return top_by_metric(categories, "category", CATEGORY_METRICS)


def busiest_merchants(merchants: DataFrame, limit: int = 10) -> DataFrame:
    """Ties in name order here, unlike the single-winner rankings."""
    return merchants.orderBy(
        F.desc("transaction_count"), "merchant", "category"
    ).limit(limit)


def series(entities: DataFrame, dimension: str, *metrics: str) -> DataFrame:
    """Chart-ready columns: the dimension and the chosen metrics."""
    return entities.select(dimension, *metrics).orderBy(dimension)


def month_series(months: DataFrame, amount: bool = False) -> DataFrame:
    if amount:
        return series(months, "month", "completed_amount")
    return series(
        months,
        "month",
        "transaction_count",
        "completed_transactions",
        "failed_transactions",
    )


def availability(entities: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric, whether every entity has it: a gap makes it unavailable."""
    known = entities.agg(
        *[F.count_if(F.col(name).isNull()).alias(name) for name in metrics]
    )
    return known.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("metric"),
                        (F.col(name) == 0).alias("available"),
                    )
                    for name in metrics
                ]
            )
        )
    )
