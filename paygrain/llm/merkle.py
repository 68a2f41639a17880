"""A Merkle manifest of a dataset: every row a leaf, every source a subtree.

Leaves are numbered within their source. A level is made by lag and lead windows over
rows in their order: a node of level k lies on the row of its first leaf, so its siblings
are a fixed 3**k and 2 * 3**k rows away, masked by its slot in the run of three and by
the run's length; the first child's row hashes the run into the parent. The siblings
also reach the leaves below, as the last ones seen on the way down the rows.

Windows cover FOLD_LEVELS levels in chunks of 3**FOLD_LEVELS consecutive rows: a chunk is
a whole subtree, so a source that holds most rows is dealt over many tasks, and one
shuffle serves all these levels. The chunks' roots are the rows of the next round, until
each source has one row; the sources' subroots are a tree of the same kind.

Rows are numbered by a sort whose last key is a row number, so that neither null nor
repeated ids make a partition that cannot be split.

Cases: nulls hash as ``-``; null doc_ids come first; rows of equal source and doc_id are
ordered by their leaf (identical rows are interchangeable); null and empty texts differ;
a row whose doc_id is null is never tampered with; an empty table gives an empty result;
texts of any length are hashed where they are read; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrain.llm.store import saved

FANOUT = 3
# Levels made from one shuffle, in chunks of 729 rows.
FOLD_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# What a run holds beside one of its nodes.
_PAIR = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(*[field(text if name == "text" else F.col(name)) for name in FIELDS])


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``pos``, the place in the group by ``order`` (from 0), and ``size`` of the group.

    Rows are sorted over all tasks; a group's rows before a task are a sum over one row
    per task and group.
    """
    placed = saved(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .orderBy(group, *order, "_row")
        .drop("_row")
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()),
        "merkle-rows",
    )
    tasks = placed.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select(
        F.col(group).alias("_group"),
        F.col("_task").alias("_of"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of"))
    return (
        placed.join(starts, same)
        .withColumn("pos", F.col("_at") + F.col("_shift"))
        .drop("_task", "_at", "_group", "_of", "_shift")
    )


def _folded(rows: DataFrame, group: str) -> DataFrame:
    """FOLD_LEVELS levels over rows (group, pos, size, hash).

    Adds ``path``, each row's siblings from its own level upwards, one pair of what
    stands before and after it per level, and ``top``, the hash of the chunk on its
    first row. A level that a group does not need changes nothing and has no pair.
    """
    rows = rows.withColumn("_chunk", F.floor(F.col("pos") / FANOUT**FOLD_LEVELS))
    spec = Window.partitionBy(group, "_chunk").orderBy("pos")
    empty = F.lit("")
    rows = rows.withColumn("_h0", F.col("hash"))
    for level in range(FOLD_LEVELS):
        apart = FANOUT**level
        here = F.col(f"_h{level}")
        nodes = F.ceil(F.col("size") / apart)
        index = F.floor(F.col("pos") / apart)
        slot = index % FANOUT
        length = F.least(F.lit(FANOUT), nodes - (index - slot))
        near, far = F.lead(here, apart).over(spec), F.lead(here, 2 * apart).over(spec)
        near_back, far_back = F.lag(here, apart).over(spec), F.lag(here, 2 * apart).over(spec)
        rows = rows.withColumns(
            {
                "_after": F.concat(
                    F.when(slot + 1 < length, near).otherwise(empty),
                    F.when(slot + 2 < length, far).otherwise(empty),
                ),
                "_before": F.concat(
                    F.when(slot > 1, far_back).otherwise(empty),
                    F.when(slot > 0, near_back).otherwise(empty),
                ),
            }
        )
        on_node = (F.col("pos") % apart == 0) & (nodes > 1)
        first_child = F.col("pos") % (apart * FANOUT) == 0
        pair = F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))
        rows = rows.withColumns(
            {
                f"_s{level}": F.when(on_node, pair),
                f"_h{level + 1}": F.when(
                    first_child, F.when(nodes > 1, digest(here, F.col("_after"))).otherwise(here)
                ),
            }
        ).drop("_before", "_after")
    so_far = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = [
        F.when(
            F.ceil(F.col("size") / FANOUT**level) > 1,
            F.last(f"_s{level}", ignorenulls=True).over(so_far),
        )
        for level in range(FOLD_LEVELS)
    ]
    helpers = [f"{kind}{level}" for kind in ("_h", "_s") for level in range(FOLD_LEVELS)]
    return (
        rows.withColumn("path", F.array_compact(F.array(*pairs)))
        .withColumnRenamed(f"_h{FOLD_LEVELS}", "top")
        .drop(*helpers)
    )


def _rounds(rows: DataFrame, group: str) -> list[DataFrame]:
    """Rows (group, pos, size, hash, ...) folded until each group is one chunk."""
    chunk = FANOUT**FOLD_LEVELS
    largest = rows.agg(F.max("size")).first()[0] or 0
    rounds = [saved(_folded(rows, group), "merkle-round")]
    while largest > chunk:
        largest = -(-largest // chunk)
        parents = rounds[-1].where("top is not null").select(
            group,
            F.col("_chunk").alias("pos"),
            F.ceil(F.col("size") / chunk).alias("size"),
            F.col("top").alias("hash"),
        )
        rounds.append(saved(_folded(parents, group), "merkle-round"))
    return rounds


def _tops(rounds: list[DataFrame], group: str, name: str) -> DataFrame:
    """(group, name): the last hash of each group."""
    return rounds[-1].where("top is not null").select(group, F.col("top").alias(name))


def _with_paths(rounds: list[DataFrame], group: str, heads: DataFrame) -> DataFrame:
    """The first round's rows with whole paths: their own, their chunks', and the heads'.

    ``heads`` has a row per group: its path from the group's top on, and other columns.
    """
    others = [name for name in heads.columns if name not in (group, "path")]
    upper = heads.withColumn("pos", F.lit(0).cast("long"))
    for number, rows in reversed(list(enumerate(rounds))):
        above = upper.select(
            F.col(group).alias("_group"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *others
        )
        # The last round's chunks are whole groups: number 0 of each.
        same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_chunk") == F.col("_pos"))
        upper = rows.join(above, same).withColumn("path", F.concat("path", "_path")).drop("_group", "_pos", "_path")
        if number:
            upper = upper.select(group, "pos", "path", *others)
    return upper


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """One row per document with its proof, checked against another state of its text.

    Columns: doc_id, leaf, subroot, root, path (siblings as pairs before and after, level
    by level), proof_sha256, folded_root (from the leaf of the text ``tampered``, a column
    over ``docs``, and the siblings), verified (whether that is the root).
    """
    text = F.col("text")
    leaves = saved(
        docs.select(
            "doc_id",
            "source",
            leaf(text).alias("hash"),
            F.when(~text.eqNullSafe(tampered), leaf(tampered)).alias("changed"),
        ),
        "merkle-leaves",
    )
    rounds = _rounds(numbered(leaves, "source", "doc_id", "hash"), "source")

    subroots = _tops(rounds, "source", "hash").withColumn("_all", F.lit(0))
    upper = _rounds(numbered(subroots, "_all", "source"), "_all")
    roots = _tops(upper, "_all", "root").withColumn("path", F.array().cast(f"array<{_PAIR}>"))
    heads = _with_paths(upper, "_all", roots).select("source", F.col("hash").alias("subroot"), "root", "path")

    folded = F.aggregate(
        "path",
        F.coalesce("changed", "hash"),
        lambda below, pair: digest(pair["before"], below, pair["after"]),
    )
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    return (
        _with_paths(rounds, "source", heads)
        .withColumn("folded_root", folded)
        .select(
            "doc_id",
            F.col("hash").alias("leaf"),
            "subroot",
            "root",
            "path",
            digest(siblings).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


def without_line_breaks(docs_text: Column, doc_id: Column) -> Column:
    """The tampering of the query: texts of even CRC-32 of the id lose their line breaks."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.regexp_replace(docs_text, "\n", "")).otherwise(docs_text)
