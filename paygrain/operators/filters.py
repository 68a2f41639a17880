"""Row filters, allowlists and paging."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrain import model


def filter_ci(
    tx: DataFrame,
    category: str | None = None,
    status: str | None = None,
    bank: str | None = None,
) -> DataFrame:
    """Case-insensitive equality on any of three columns; None or "" is no filter."""
    wanted = {
        "merchant_category": category,
        "transaction_status": status,
        "bank_name": bank,
    }
    for name, value in wanted.items():
        if value:
            tx = tx.where(F.lower(F.col(name)) == value.strip().lower())
    return tx


def filter_in(
    tx: DataFrame,
    categories: Iterable[str] = (),
    statuses: Iterable[str] = (),
    banks: Iterable[str] = (),
) -> DataFrame:
    """Exact membership on any of three columns; an empty list is no filter."""
    wanted = {
        "merchant_category": list(categories),
        "transaction_status": list(statuses),
        "bank_name": list(banks),
    }
    for name, chosen in wanted.items():
        if chosen:
            tx = tx.where(F.col(name).isin(chosen))
    return tx


def category_gate(tx: DataFrame, categories: Iterable[str]) -> DataFrame:
    """Nothing is shown until at least one category is chosen."""
    return tx if list(categories) else tx.where(F.lit(False))


def completed(tx: DataFrame) -> DataFrame:
    return tx.where("is_successful")


def records(tx: DataFrame) -> DataFrame:
    return tx.select(*model.RECORD_COLUMNS)


def display_rows(tx: DataFrame) -> DataFrame:
    return tx.select(*model.DISPLAY_COLUMNS)


def safe_rows(tx: DataFrame) -> DataFrame:
    return tx.select(*model.SAFE_COLUMNS)


def latest_first(tx: DataFrame) -> DataFrame:
    return display_rows(tx).orderBy(F.desc("transaction_date"), "transaction_id")


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


# Offsets up to here are reached by a top-k; further ones by counts per id range.
SHALLOW = 10_000
# Characters that ids of one range, and ranges of one group, have in common.
RANGE_CHARS, GROUP_CHARS = 11, 7


def page(
    tx: DataFrame,
    limit: int = 50,
    offset: int = 0,
    after: str | None = None,
    complete: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One page of records in transaction order, with the unpaged total.

    ``tx`` needs the columns that filters use; ``complete`` adds the others to
    the rows of the page. ``after`` continues behind a transaction id, which
    costs the same for every page; a deep offset costs a count per id range.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    total = tx.select(F.count(F.lit(1))).scalar()
    rows = tx if after is None else tx.where(F.col("transaction_id") > after)
    if offset + limit > SHALLOW:
        rows = _from_offset(rows, limit, offset)
    else:
        rows = rows.orderBy("transaction_id").offset(offset).limit(limit)
    rows = complete(rows) if complete else rows
    return (
        records(rows)
        .orderBy("transaction_id")
        .select(
            total.alias("total"),
            F.lit(limit).alias("limit"),
            F.lit(offset).alias("offset"),
            "*",
        )
    )


def _from_offset(tx: DataFrame, limit: int, offset: int) -> DataFrame:
    """The rows at these places in transaction order; only their ranges are numbered."""
    met = (F.col("_start") < offset + limit) & (F.col("_start") + F.col("_n") > offset)
    starts = _range_starts(tx, "transaction_id", RANGE_CHARS, GROUP_CHARS).where(met)
    placed = _numbered(tx, starts, "transaction_id", RANGE_CHARS)
    return placed.where(
        (F.col("_place") >= offset) & (F.col("_place") < offset + limit)
    ).drop("_place")


def with_place(df: DataFrame, key: str, range_chars: int, group_chars: int) -> DataFrame:
    """Add ``_place``, the row's place in the order of a text key, from 0.

    Rows are counted per range (keys that begin alike) and sums over the counts
    tell where each range starts, so no task orders all rows.
    """
    return _numbered(df, _range_starts(df, key, range_chars, group_chars), key, range_chars)


def _range_starts(df: DataFrame, key: str, range_chars: int, group_chars: int) -> DataFrame:
    """(_range, _n, _start): rows of each range, and rows before it."""
    span = F.substring(key, 1, range_chars)
    counts = df.groupBy(span.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_group", F.substring("_range", 1, group_chars))
    groups = counts.groupBy(F.col("_group").alias("_g")).agg(F.sum("_n").alias("_all"))
    earlier = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy("_group")
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    groups = groups.select(
        "_g", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before")
    )
    start = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    return counts.join(groups, F.col("_group").eqNullSafe(F.col("_g"))).select(
        "_range", "_n", start.alias("_start")
    )


def _numbered(df: DataFrame, starts: DataFrame, key: str, range_chars: int) -> DataFrame:
    span = F.substring(key, 1, range_chars)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return (
        df.join(starts, span.eqNullSafe(F.col("_range")))
        .withColumn("_place", F.col("_start") + place - 1)
        .drop("_range", "_n", "_start")
    )
