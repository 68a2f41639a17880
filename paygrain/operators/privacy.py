"""Removal of private fields from nested data."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrain.functions.messages import PRIVATE_FIELDS, redact
from paygrain.functions.values import casefold


def sanitize(df: DataFrame, private: Collection[str] = PRIVATE_FIELDS) -> DataFrame:
    """Drop private fields by name at any depth and redact the text that stays."""
    names = {name.casefold() for name in private}
    return df.select(
        *[
            _clean(F.col(f"`{field.name}`"), field.dataType, names).alias(field.name)
            for field in df.schema.fields
            if field.name.casefold() not in names
        ]
    )


def _clean(value: Column, kind: T.DataType, names: set[str]) -> Column:
    if isinstance(kind, T.StringType):
        return redact(value)
    if isinstance(kind, T.StructType):
        kept = [
            _clean(value.getField(field.name), field.dataType, names).alias(field.name)
            for field in kind.fields
            if field.name.casefold() not in names
        ]
        whole = F.struct(*kept) if kept else F.lit(None)
        return F.when(value.isNotNull(), whole)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _clean(item, kind.elementType, names))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(
            value, lambda key, _: ~casefold(key.cast("string")).isin(*names)
        )
        return F.transform_values(
            kept, lambda _, item: _clean(item, kind.valueType, names)
        )
    return value
