"""Parsing and arithmetic expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrain.model import MONEY

# All characters that count as white space, not just the blank that SQL TRIM
# removes.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Plain decimal or exponent notation. The JVM parser alone would also accept
# Java literals such as "10d".
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use).getItem(0)


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(WHITESPACE))


def casefold(column: Column) -> Column:
    """Lower case plus the foldings that matter for comparing European text."""
    folded = F.lower(column)
    for letter, plain in (("ß", "ss"), ("ſ", "s"), ("ς", "σ")):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return folded


def is_blank(column: Column) -> Column:
    """Nothing but white space. One side is enough, and cheaper than both."""
    return F.ltrim(column, F.lit(WHITESPACE)) == ""


def number(column: Column, data_type: T.DataType) -> Column:
    """Double, or null where the value is not a number. Infinity may remain."""
    if isinstance(data_type, T.StringType):
        text = strip(column)
        return F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return column.cast("double")


def positive_finite(value: Column) -> Column:
    """False for null, zero, negatives, NaN and infinity.

    Spark sorts NaN above infinity, so the upper bound rejects both.
    """
    return F.coalesce((value > 0) & (value < F.lit(float("inf"))), F.lit(False))


def money(value: Column) -> Column:
    return value.cast(MONEY)


def day(column: Column) -> Column:
    """Strict date: malformed text fails the job."""
    return column.cast("date")


def day_or_null(column: Column) -> Column:
    return column.try_cast("date")


def month(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def flag(column: Column, data_type: T.DataType, name: str) -> Column:
    """Boolean column; text must be true/false/1/0, anything else is an error."""
    if isinstance(data_type, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    text = F.lower(strip(column.cast("string")))
    return (
        F.when(text.isin("true", "1"), F.lit(True))
        .when(text.isin("false", "0"), F.lit(False))
        .otherwise(F.raise_error(F.lit(f"invalid {name} values")).cast("boolean"))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Fraction as double; 0 when there is nothing to divide by."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")),
        F.lit(0.0),
    )
