"""Reproducible random draws that depend only on the seed and the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, what: str, *key: Column) -> Column:
    """A double in [0, 1) from 52 bits of an MD5, the same under any partitioning."""
    parts = [F.coalesce(part.cast("string"), F.lit("")) for part in key]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def between(draw: Column, low: int, high: int) -> Column:
    """Integer from low to high, both included."""
    return (F.floor(draw * (high - low + 1)) + low).cast("int")


def choice(draw: Column, options: Sequence) -> Column:
    """One of the options, all equally likely."""
    literals = F.array(*[F.lit(option) for option in options])
    return F.element_at(literals, between(draw, 1, len(options)))


def weighted(draw: Column, weights: dict[str, float]) -> Column:
    """One of the keys, with probability in proportion to its weight."""
    total = sum(weights.values())
    names = list(weights)
    reached, result = 0.0, None
    for name in names[:-1]:
        reached += weights[name] / total
        test = draw < reached
        result = (
            F.when(test, name) if result is None else result.when(test, name)
        )
    return result.otherwise(names[-1]) if result is not None else F.lit(names[-1])
