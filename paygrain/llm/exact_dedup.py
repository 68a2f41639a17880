"""Exact duplicates: a two-pass Bloom filter finds the hashes that may be repeated.

Pass one hashes every text and counts how often each of the filter's slots is hit; the
filter holds the slots hit at least twice. Pass two tests every row against it: a row
one of whose slots was hit once is the only one of its text and passes straight
through; only the others are shuffled and compared by their SHA-256.

The filter has a fixed number of slots, so broadcasting it is bounded (FILTER_SLOTS / 64
words). With very many rows it lets more rows through to the comparison, never fewer:
results do not depend on its size. Everything is built-in expressions.

Cases: a null text counts as empty; empty texts equal each other; of equal texts the
one with the most code points stays, then the smallest doc_id (null last), then any one
of identical rows; an empty table gives an empty result; other columns are kept, also
if they are named like the ones used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.llm.store import saved

# The characters that equality ignores.
IGNORED = " \t\n\x0b\f\r"
# 2**26 slots are at most 2**20 words of 64 bits: the bound of the broadcast.
FILTER_SLOTS = 1 << 26
HASHES = 2


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normal_text(text), 256))


def _slots(digest: Column) -> list[Column]:
    """One slot per hash function, each in a part of the filter of its own."""
    part = FILTER_SLOTS // HASHES
    return [
        F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(part)) + F.lit(k * part)
        for k in range(HASHES)
    ]


def repeated_slots(keys: DataFrame, digest: str) -> DataFrame:
    """The filter: words of 64 slots with a bit for every slot hit more than once."""
    slots = keys.select(F.explode(F.array(*_slots(F.col(digest)))).alias("slot"))
    often = slots.groupBy("slot").agg(F.count("*").alias("hits")).where("hits > 1")
    return often.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")
    )


def with_maybe_repeated(rows: DataFrame, digest: str, filter_words: DataFrame) -> DataFrame:
    """Add ``_maybe``: false only where no other row can have the same digest."""
    words = F.broadcast(filter_words)
    hit = F.lit(True)
    for k, slot in enumerate(_slots(F.col(digest))):
        one = words.select(F.col("word").alias(f"_word{k}"), F.col("bits").alias(f"_bits{k}"))
        rows = (
            rows.withColumn(f"_slot{k}", slot)
            .join(one, F.shiftright(f"_slot{k}", 6) == F.col(f"_word{k}"), "left")
        )
        bit = F.expr(f"getbit(_bits{k}, cast(_slot{k} & 63 as int))")
        hit = hit & F.coalesce(bit == 1, F.lit(False))
    helpers = [f"{name}{k}" for name in ("_slot", "_word", "_bits") for k in range(HASHES)]
    return rows.withColumn("_maybe", hit).drop(*helpers)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = saved(
        docs.select(
            "doc_id",
            F.length(F.coalesce("text", F.lit(""))).alias("points"),
            text_digest(F.col("text")).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-keys",
    )
    filter_words = saved(repeated_slots(keys, "digest"), "dedup-filter")
    tested = with_maybe_repeated(keys, "digest", filter_words)
    once = tested.where("not _maybe")
    maybe = tested.where("_maybe")
    best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row"))
    groups = saved(
        maybe.groupBy("digest")
        .agg(F.count("*").alias("size"), best.alias("best"))
        .where("size > 1")
        .select(
            "digest",
            "size",
            F.col("best.doc_id").alias("best_id"),
            F.col("best.row").alias("best_row"),
        ),
        "dedup-groups",
    )
    single = F.col("size").isNull()
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    compared = maybe.join(groups, "digest", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("best_row"))).alias("kept"),
        sha,
    )
    return once.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        sha,
    ).unionByName(compared)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"),
        text_digest(F.col("text")).alias("_digest"),
    )
    filter_words = saved(
        repeated_slots(docs.select(text_digest(F.col("text")).alias("_digest")), "_digest"),
        "dedup-filter",
    )
    tested = with_maybe_repeated(rows, "_digest", filter_words)
    once = tested.where("not _maybe").select("_row.*")
    text = F.coalesce("_row.text", F.lit(""))
    order = F.struct(
        -F.length(text), F.col("_row.doc_id").isNull(), F.col("_row.doc_id"), text
    )
    first = (
        tested.where("_maybe")
        .groupBy("_digest")
        .agg(F.min_by("_row", order).alias("_row"))
        .select("_row.*")
    )
    return once.unionByName(first)
