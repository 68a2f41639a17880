"""Which entity names occur in which texts, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.functions.messages import name_form
from paygrain.functions.values import bind
from paygrain.operators.cleaning import keep_first

PIECE = 8


def _pieces(text: Column, length: Column) -> Column:
    """All substrings of the given length, in order; none when text is shorter.

    A look-ahead consumes nothing, so one scan yields the overlapping pieces.
    """
    pattern = F.concat(F.lit("(?s)(?=(.{"), length.cast("string"), F.lit("}))"))
    return F.regexp_extract_all(text, pattern, F.lit(1))


def _anchored(names: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Names with one piece each: the whole name, or its rarest piece if long."""
    forms = (
        names.withColumn("_form", name_form(F.col("name")))
        .where(F.col("_form") != "")
        .withColumn("_length", F.least(F.length("_form"), F.lit(PIECE)))
    )
    pieces = forms.select(
        *id_columns,
        "_form",
        F.posexplode(_pieces(F.col("_form"), F.col("_length"))).alias(
            "_position", "_piece"
        ),
    )
    # Counted exactly: a piece's rank must not depend on how many names there are.
    uses = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_uses"))
    return keep_first(
        pieces.join(uses, "_piece"),
        [*id_columns, "_form"],
        ["_uses", "_position"],
    ).select(*id_columns, "_form", "_piece")


def entity_mentions(
    texts: DataFrame,
    names: DataFrame,
    text_id: Sequence[str],
    column: str = "text",
) -> DataFrame:
    """(text id, kind, name) for every name that occurs in a text.

    ``names`` holds distinct (kind, name); ``text_id`` identifies a text. Case
    and punctuation are ignored on both sides; a name may start or end inside a
    word. Every name is looked up by one short piece of itself: texts are turned
    into their distinct pieces, without the text itself, and joined on equality.
    What matches goes back to its text, where longer names are checked in full.
    The piece lengths in use (at most eight) come from the names.
    """
    anchored = _anchored(names, ["kind", "name"])
    lengths = anchored.select(F.collect_set(F.length("_piece"))).scalar()
    # Spread evenly before every text becomes hundreds of pieces; joining the
    # candidates back to their texts reuses the same shuffle.
    forms = texts.select(*text_id, name_form(F.col(column)).alias("_text")).repartition(
        *text_id
    )
    pieces = F.array_distinct(_pieces(F.col("_text"), F.col("_length")))
    spread = forms.withColumn("_length", F.explode(lengths)).select(
        *text_id, F.explode(pieces).alias("_piece")
    )
    # Spark estimates the pieces at the size of the texts and would broadcast
    # them. A semi join can only broadcast its right side, the names, and only
    # while they are small; it keeps the few pieces that are worth joining.
    # Those are spread again, so that both joins have shuffles of their own and
    # Spark can split a piece that very many texts contain.
    hits = spread.join(anchored.select("_piece"), "_piece", "left_semi").repartition(
        *text_id
    )
    candidates = hits.join(anchored.hint("merge"), "_piece").select(
        *text_id, "kind", "name", "_form"
    )
    is_long = F.length("_form") > PIECE
    return (
        candidates.join(forms, list(text_id))
        .where(~is_long | F.col("_text").contains(F.col("_form")))
        .select(*text_id, "kind", "name")
    )


def listed_mentions(
    texts: DataFrame,
    kind: str,
    names: Sequence[str],
    text_id: Sequence[str],
    column: str = "text",
) -> DataFrame:
    """The same for a short list of names known beforehand, such as the banks.

    One pass over the texts without a shuffle: the list is part of the plan.
    """

    def mentioned(text: Column) -> Column:
        found = []
        for name in names:
            form = name_form(F.lit(name))
            found.append(F.when((form != "") & text.contains(form), F.lit(name)))
        return F.array_compact(F.array(*found))

    return texts.select(
        *text_id,
        F.lit(kind).alias("kind"),
        F.explode(bind(name_form(F.col(column)), mentioned)).alias("name"),
    )
