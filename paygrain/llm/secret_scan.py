"""Secrets in texts, told apart by who owns them across the corpus.

Every text is searched for labelled assignments, access keys and long hex strings (base
kinds) and for other long mixed strings. The hash of every candidate value is counted
over the whole corpus by distinct repositories and distinct owners, where equal texts are
one repository of one owner (the first): a copy says nothing new. A value that several
owners hold, or that one holds in many repositories, is a widely copied example; any
other is specific to its owner, and if it looks live (mixed characters, many different
ones) it is a credential. Both are added as spans of kind `example` and `live` at the
value's place.

All of it is built-in expressions. Positions are code points: the pieces that a text
falls into between matches, and the matches, are measured and summed up in blocks, so a
text with many matches costs little more than its length.

Cases: a null text counts as empty; a null owner or repository counts as one of its own;
repeated rows are counted once and each keep their spans; texts may be long and hold any
number of matches; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.functions.values import bind
from paygrain.llm.store import saved

# The base kinds in their order, and what counts as a match of each. For
# the last two, a run shorter than wanted can hold no match, so the length is in the
# pattern; an assignment's value is measured after the match.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "example", "live")
# Other strings that may be secrets: long, of these characters, with digits and letters.
MIXED = r"[A-Za-z0-9+/_-]{20,}"

# A value held by so many owners, or in so many repositories in all, is an example.
EXAMPLE_OWNERS = 2
EXAMPLE_REPOSITORIES = 8
LIVE_LENGTH = 16
LIVE_CHARACTERS = 8
# Matches whose places are summed up at a time.
BLOCK_MATCHES = 512


def _sums_before(lengths: Column) -> Column:
    """For every element the sum of those before it; twice over, in blocks and of blocks."""

    def running(values: Column, start: Column) -> Column:
        none = F.expr("cast(array() as array<int>)")
        state = F.struct(start.alias("at"), none.alias("all"))
        return F.aggregate(
            values,
            state,
            lambda s, v: F.struct(
                (s["at"] + v).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")
            ),
            lambda s: s["all"],
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, v: a + v)

    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK_MATCHES).cast("int"))
    blocks = F.transform(
        starts, lambda i: F.slice(lengths, i * BLOCK_MATCHES + 1, F.lit(BLOCK_MATCHES))
    )
    return bind(
        blocks,
        lambda parts: F.flatten(
            F.zip_with(parts, running(F.transform(parts, total), F.lit(0)), running)
        ),
    )


def _matches(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """array<struct<start, kind, end, value_start, value>> of a pattern's matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    # The pieces between the matches, each as long as its text up to the next match.
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.transform(whole, F.length).alias("sizes"),
        values.alias("values"),
    )

    def placed(found: Column) -> Column:
        steps = F.zip_with(found["gaps"], found["sizes"], lambda gap, size: gap + F.coalesce(size, F.lit(0)))
        return bind(_sums_before(steps), lambda before: F.transform(found["values"], lambda value, i: span(found, before, value, i)))

    def span(found: Column, before: Column, value: Column, i: Column) -> Column:
        start = F.get(before, i) + F.get(found["gaps"], i)
        end = start + F.get(found["sizes"], i)
        return F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            (end - F.length(value)).alias("value_start"),
            value.alias("value"),
        )

    empty = F.expr(
        "cast(array() as array<struct<start:int,kind:int,end:int,value_start:int,value:string>>)"
    )
    spans = bind(parts, placed)
    kept = F.filter(spans, lambda m: F.length(m["value"]) >= least) if least else spans
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: doc_id, owner, repository, content, row, base spans, candidate values."""
    text = F.coalesce("text", F.lit(""))
    mixed = F.filter(
        _matches(text, MIXED, 3, 0, 0),
        lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"),
    )
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.md5(text).alias("content"),
        F.monotonically_increasing_id().alias("row"),
        _matches(text, ASSIGN, 0, 2, ASSIGN_VALUE).alias("assign"),
        _matches(text, ACCESS, 1, 0, 0).alias("access"),
        _matches(text, HEX, 2, 0, 0).alias("hex"),
        mixed.alias("mixed"),
    )
    spans = F.array_sort(F.concat("assign", "access", "hex"))
    candidates = F.transform(
        F.concat("assign", "access", "hex", "mixed"),
        lambda m: F.struct(
            m["value_start"].alias("start"),
            m["end"].alias("end"),
            F.sha2(m["value"], 256).alias("hash"),
            looks_live(m["value"]).alias("live"),
        ),
    )
    return rows.select(
        "doc_id", "owner", "repository", "content", "row",
        F.transform(spans, lambda m: F.struct(m["start"], m["kind"], m["end"])).alias("spans"),
        candidates.alias("candidates"),
    )


def looks_live(value: Column) -> Column:
    """Long, letters and digits, and enough different characters: not a placeholder."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.length(value) >= LIVE_LENGTH)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (different >= LIVE_CHARACTERS)
    )


def ownership(occurrences: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over the corpus.

    Occurrences (hash, owner, repository, content) collapse per text, which counts for
    the first of its owners, then per repository, then per owner, before they meet: a
    value that fills a third of the corpus reaches a task as one row per owner and
    earlier task.
    """
    return (
        occurrences.groupBy("hash", "content")
        .agg(F.min(F.struct("owner", "repository")).alias("held"))
        .groupBy("hash", F.col("held.owner").alias("owner"), F.col("held.repository").alias("repository"))
        .agg(F.lit(1))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: doc_id, base spans and all spans as arrays of (start, kind, end)."""
    rows = saved(scanned(docs, owner, repository), "secret-scan")
    found = rows.where(F.size("candidates") > 0).select(
        "row", "owner", "repository", "content", F.inline("candidates")
    )
    owned = saved(ownership(found), "secret-owners")
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    verdict = F.when(copied, 3).when(F.col("live"), 4)
    # A value that fills much of the corpus is a skewed key here; both sides come from
    # written tables, so the planner may split it.
    added = (
        found.join(owned, "hash")
        .withColumn("kind", verdict)
        .where("kind is not null")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return rows.join(added, "row", "left").select(
        "doc_id",
        "spans",
        F.array_sort(F.concat("spans", F.coalesce("added", none))).alias("all_spans"),
    )


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["kind"] == KINDS.index(kind))).cast("long")
