"""Mix sources to target weights by Poisson replication.

Each document is repeated a Poisson-distributed number of times whose mean is the
repetition rate of its source: target share times wanted total, divided by the source's
documents. The number is the inverse of the distribution at a hash of the seed, the row
and its number among identical rows, so it is the same in any order, partitioning or
retry. Copies then go to partitions by a hash and are sorted by it within them: a global
shuffle, without sampling or a hot key.

Rows that are identical in all columns are found by counting row hashes; only they are
brought together, as one row with a count, and dealt out again in blocks. All other rows
are shuffled once, as copies.

Rates above DRAW_RATE are split into equal draws with hashes of their own, since a sum of
Poisson numbers is one; so a tiny source may be repeated any number of times.

Cases: null sources form a source of their own; ids play no part of their own, so rows
whose doc_id is null or repeated are drawn one by one like all others; identical rows are
drawn by their numbers from 1; texts may be null, empty or long; a source with weight 0 or absent from given weights is left out; an empty table stays empty; other
columns are kept, also if they are named like the ones used here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.llm.merkle import field
from paygrain.llm.store import saved

DRAW_RATE = 16.0
# Terms of the distribution: beyond them a share below 2**-52 is left at DRAW_RATE.
TERMS = 80
# Up to this many sources, the table of rates is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 50_000
# Up to this many repeated row hashes (some 60 bytes each) likewise.
BROADCAST_REPEATS = 200_000
# Identical rows made in one task.
BLOCK_ROWS = 4096


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    total: float | None = None,
) -> DataFrame:
    """(source, rate): mean repetitions that give every source its target share.

    Target shares are the given weights, or the sources' sizes to the power
    ``exponent`` (1 keeps the mixture, 0 makes all sources equal). ``total`` is the
    expected size of the mixture, as many documents as given by default.
    """
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(float(exponent)))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    weighted = sizes.withColumn("_weight", weight)
    sums = weighted.agg(
        F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("weights"),
        F.coalesce(F.sum("_size"), F.lit(0)).alias("rows"),
    ).first()
    if not sums.weights:
        return weighted.select("_source", F.lit(0.0).alias("_rate"))
    wanted = float(sums.rows if total is None else total)
    share = F.col("_weight") / F.lit(float(sums.weights))
    return weighted.select("_source", (F.lit(wanted) * share / F.col("_size")).alias("_rate"))


def _distribution(rate: Column) -> Column:
    """The first cumulative Poisson probabilities for a rate."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def grow(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grow, lambda s: s["all"])


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def row_hash(names: list[str]) -> Column:
    """A hash of all columns; nulls differ from empty texts."""
    return F.md5(F.concat(*[field(F.col(f"`{name}`")) for name in names]))


def _uniform(digest: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def replicated(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    total: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Every copy of every document, in shuffled order.

    The documents' columns with ``copy`` (from 1), ``copies`` and ``mix_key``; a
    document's own columns of these names are replaced.
    """
    rates = source_rates(docs, weights, exponent, total)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    draws = F.greatest(F.ceil(F.col("_rate") / DRAW_RATE), F.lit(1))
    rates = rates.where("_rate > 0").select(
        "_source", draws.alias("_draws"), _distribution(F.col("_rate") / draws).alias("_cdf")
    )
    own = [name for name in docs.columns if name not in ("copy", "copies", "mix_key")]
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in own]).alias("_row"),
        row_hash(own).alias("_hash"),
        F.col("source").alias("_key"),
    )
    joined = _numbered(rows).join(
        F.broadcast(rates) if few else rates, F.col("_key").eqNullSafe(F.col("_source"))
    )
    drawn = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("_draws")),
        lambda k: F.size(
            F.filter(
                "_cdf", lambda c: c <= _uniform(_hash(str(seed), F.col("_hash"), F.col("_number"), k))
            )
        ),
    )
    counted = joined.withColumn(
        "copies", F.aggregate(drawn, F.lit(0).cast("long"), lambda a, b: a + b)
    ).where("copies > 0")
    copies = counted.select(
        "_row", "_hash", "_number", "copies",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    key = _hash(str(seed), "shuffle", F.col("_hash"), F.col("_number"), F.col("copy"))
    return (
        copies.select("_row.*", "copy", "copies", key.alias("mix_key"))
        .repartition("mix_key")
        .sortWithinPartitions("mix_key")
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``_number``, from 1 among rows of one hash.

    Which of the identical rows has which number makes no difference: they are counted,
    and as many are made again, in blocks that go to different tasks.
    """
    repeats = saved(
        rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1"), "mixing-repeats"
    )
    few = repeats.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS
    marked = rows.join(F.broadcast(repeats) if few else repeats, "_hash", "left")
    once = marked.where("_n is null").drop("_n").withColumn("_number", F.lit(1).cast("long"))
    first = (
        marked.where("_n is not null")
        .groupBy("_hash", "_n")
        .agg(F.first("_row").alias("_row"), F.first("_key").alias("_key"))
    )
    blocks = first.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK_ROWS)))
    ).repartition("_hash", "_block")
    low = F.col("_block") * BLOCK_ROWS + 1
    high = F.least(low + BLOCK_ROWS - 1, F.col("_n"))
    again = blocks.withColumn("_number", F.explode(F.sequence(low, high)))
    return once.unionByName(again.select(*once.columns))
