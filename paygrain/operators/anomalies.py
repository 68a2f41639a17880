"""Review signal for unusually large or small amounts."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrain.operators.measures import spread


def scored(
    df: DataFrame, column: str = "amount", stats: DataFrame | None = None
) -> DataFrame:
    """Every row with its z-score against the whole table.

    The two global figures come from a scalar subquery over the one column, so
    the rows themselves are neither shuffled nor gathered. Pass ``stats`` (one
    row: mean, std) where they are known already. No spread, no score.
    """
    known = spread(df, column) if stats is None else stats
    stats = known.select(F.struct("mean", "std")).scalar()
    deviation = F.col(column).cast("double") - stats.getField("mean")
    return df.withColumn(
        "amount_z_score", F.try_divide(deviation, stats.getField("std"))
    )


def amount_anomalies(
    df: DataFrame,
    z_threshold: float = 3.0,
    column: str = "amount",
    key: str = "transaction_id",
    stats: DataFrame | None = None,
) -> DataFrame:
    """Rows whose score reaches the threshold on either side, largest first.

    The key settles ties and keeps rows of one amount from sorting in one task.
    """
    reached = F.coalesce(F.abs("amount_z_score") >= z_threshold, F.lit(False))
    return (
        scored(df, column, stats)
        .withColumn("amount_anomaly", reached)
        .where("amount_anomaly")
        .orderBy(F.desc(column), key)
    )


def known_anomalies(
    df: DataFrame,
    mean: float | None,
    std: float | None,
    z_threshold: float = 3.0,
    column: str = "amount",
    key: str = "transaction_id",
) -> DataFrame:
    """``amount_anomalies`` where mean and spread are known numbers.

    The scores' threshold then is two bounds of the column, which file
    statistics can rule out. The bounds are drawn a little too wide, and the
    score itself decides.
    """
    if not std:
        df, mean, std = df.where(F.lit(False)), 0.0, 1.0
    far = z_threshold * std
    slack = 1e-9 * (abs(mean) + far)
    low = _bound(df, column, mean - far + slack, ROUND_CEILING)
    high = _bound(df, column, mean + far - slack, ROUND_FLOOR)
    outside = (F.col(column) <= low) | (F.col(column) >= high)
    score = (F.col(column).cast("double") - F.lit(mean)) / F.lit(std)
    return (
        df.where(outside)
        .withColumn("amount_z_score", score)
        .withColumn("amount_anomaly", F.abs("amount_z_score") >= z_threshold)
        .where("amount_anomaly")
        .orderBy(F.desc(column), key)
    )


def _bound(df: DataFrame, column: str, value: float, rounding: str) -> Column:
    """A literal of the column's own type; the outermost one if the value lies beyond."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.DecimalType):
        return F.lit(value)
    unit = Decimal(1).scaleb(-kind.scale)
    most = Decimal(10) ** (kind.precision - kind.scale) - unit
    clamped = max(-most, min(most, Decimal(value)))
    return F.lit(clamped.quantize(unit, rounding)).cast(kind)
