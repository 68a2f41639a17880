"""Chat formatting with a prefix tree of conversations.

Every conversation is a path of turns; conversations that begin alike share nodes. A node
is known by a 128-bit hash of its path, made by a running xor of hashes of (depth, turn),
so no path is gathered to name its nodes. Conversations are sorted by their paths of turn
digests, which puts the nodes into depth-first order when each is emitted by the first
conversation that has it. An emitted node carries its text once, the place of its first
position within its path, its place in the stream of emitted positions, and the
intervals of the stream that it attends to: those of its ancestors, and its own branch.
Positions are code points of the formatted text; a tokenizer may be applied to segments.

Template: ``<s>[role]text</s>`` per turn, where every backslash, ``<``, ``[`` and ``]``
inside role and text is led by a backslash, so no control string can occur in them. The
loss mask covers the text of assistants.

Cases: null texts and roles are empty; turns are ordered by number (null first), role,
then a hash of the turn; a null conv_id is a conversation of its own; repeated rows are
repeated turns; equal conversations share every node; an empty table gives empty files;
other columns are not read. Digests are streamed over sorted rows, so a conversation of
any length needs no memory for its text; its path key needs 16 bytes a turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrain.llm.store import saved

# The template.
OPEN, CLOSE = "<s>", "</s>"
ESCAPED = r"([\\<\[\]])"
SEGMENT = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]((?:[^\\<]|\\.)*)</s>", re.DOTALL)
LEARNED = "assistant"

DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


@dataclass
class Formatted:
    """nodes: emitted once, depth-first; paths: every conversation's nodes in order."""

    nodes: DataFrame
    paths: DataFrame


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with depth, segment, node key, parent's place in the path, and a digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN + "["), escaped(role), F.lit("]"))
    body = escaped(text)
    rows = conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.length(head).alias("text_at"),
        F.length(body).alias("text_chars"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("digest"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chars = F.length("segment").cast("long")
    return (
        rows.withColumn("depth", F.row_number().over(order))
        .withColumn("key_a", F.bit_xor(F.xxhash64("depth", "digest")).over(so_far))
        .withColumn("key_b", F.bit_xor(F.xxhash64("digest", "depth", F.lit(1))).over(so_far))
        .withColumn("position", F.sum(chars).over(so_far) - chars)
        .withColumn("chars", chars)
        .drop("turn")
    )


def formatted(conversations: DataFrame) -> Formatted:
    """Format conversations and write the tree to the shared folder."""
    rows = saved(turns(conversations), "chat-turns")
    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", "digest"))), lambda t: t["digest"])
    ordered = (
        rows.groupBy("conv_id")
        .agg(F.array_join(path, "").alias("path"))
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .select("conv_id", F.monotonically_increasing_id().alias("place"))
    )
    placed = saved(_with_place(rows, saved(ordered, "chat-order")), "chat-placed")
    key = ["key_a", "key_b"]
    first = placed.groupBy(*key).agg(F.min("place").alias("place"))
    emitted = saved(placed.join(first, [*key, "place"]), "chat-emitted")
    nodes = saved(_attended(placed, _streamed(emitted)), "chat-nodes")
    return Formatted(nodes, placed.select("conv_id", "depth", *key))


def _with_place(rows: DataFrame, order: DataFrame) -> DataFrame:
    named = order.select(F.col("conv_id").alias("_conv"), "place")
    return rows.join(named, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def _streamed(emitted: DataFrame) -> DataFrame:
    """Emitted nodes with their place in the stream of all emitted positions.

    Sums run within a branch, over the branches of a sorted partition, and over the
    partitions: no window holds more than one of these.
    """
    branches = emitted.groupBy("place").agg(F.sum("chars").alias("branch_chars"))
    parts = branches.withColumn("part", F.shiftright("place", 33))
    sizes = parts.groupBy("part").agg(F.sum("branch_chars").alias("part_chars"))
    earlier = (Window.unboundedPreceding, -1)
    part_start = F.coalesce(F.sum("part_chars").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0))
    in_part = Window.partitionBy("part").orderBy("place").rowsBetween(*earlier)
    starts = parts.withColumn(
        "in_part", F.coalesce(F.sum("branch_chars").over(in_part), F.lit(0))
    ).join(sizes.select("part", part_start.alias("part_start")), "part")
    in_branch = Window.partitionBy("place").orderBy("depth").rowsBetween(*earlier)
    return (
        emitted.withColumn("_before", F.coalesce(F.sum("chars").over(in_branch), F.lit(0)))
        .join(
            starts.select("place", (F.col("in_part") + F.col("part_start")).alias("branch_start")),
            "place",
        )
        .withColumn("start", F.col("branch_start") + F.col("_before"))
        .drop("_before")
    )


def _attended(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with ``inherited``: the stream's intervals of the ancestors of their branch.

    A node attends to the inherited intervals and to [branch_start, its end).
    """
    nodes = saved(nodes, "chat-streamed")
    origin = nodes.select(
        "key_a", "key_b", F.col("place").alias("of"), "start", (F.col("start") + F.col("chars")).alias("end")
    )
    emitters = nodes.select("place").distinct()
    pieces = (
        placed.select("place", "key_a", "key_b")
        .join(emitters, "place", "left_semi")
        .join(origin, ["key_a", "key_b"])
        .where("of != place")
        .groupBy("place", "of")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    inherited = pieces.groupBy("place").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("inherited")
    )
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return (
        nodes.join(inherited, "place", "left")
        .select(
            "key_a", "key_b", "place", "depth", "segment", "chars", "position", "start", "branch_start",
            F.coalesce("inherited", none).alias("inherited"),
            F.when(F.col("role") == LEARNED, F.struct("text_at", (F.col("text_at") + F.col("text_chars")).alias("text_end"))).alias("loss"),
        )
        .repartitionByRange("place", "depth")
        .sortWithinPartitions("place", "depth")
    )


def read_back(output: Formatted) -> DataFrame:
    """Per conversation, from the emitted nodes: digests of its turns and learned text."""
    nodes = output.nodes.select("key_a", "key_b", "segment", "loss")
    rows = (
        output.paths.join(nodes, ["key_a", "key_b"])
        .select("conv_id", "depth", "segment", F.col("loss.text_at").alias("at"), F.col("loss.text_end").alias("end"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "depth")
    )
    return rows.mapInArrow(_digests, DIGESTS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted segments; a conversation ends where the next begins."""
    current, state = None, None
    for batch in batches:
        done = []
        for conv, _, segment, at, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != current:
                if state is not None:
                    done.append(_row(current, state))
                current, state = conv, [0, sha256(), 0, sha256(), 0]
            role, text = SEGMENT.fullmatch(segment).groups()
            state[0] += 1
            state[1].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
            if at is not None:
                learned = unescaped(segment[at:end])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(segment)
        if done:
            yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([_row(current, state)])


def _row(conv: int | None, state: list) -> tuple:
    n, whole, chars, learned, size = state
    return conv, n, whole.hexdigest(), chars, learned.hexdigest(), size


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
