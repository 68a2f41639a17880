"""Jobs over message tables: (conv_id, turn, role, text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrain.functions import messages as M
from paygrain.functions.values import casefold, strip
from paygrain.sources import support_topics

HISTORY = 10
BLOCK_TURNS = 4096


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, M.redact(F.col(column)))


def unsafe_flags(df: DataFrame, column: str = "text") -> DataFrame:
    """Why a generated text must not be shown, one flag per reason."""
    text = F.col(column)
    return df.withColumns(
        {
            "asks_for_credentials": M.asks_for_credentials(text),
            "has_digits": M.has_digits(text),
            "changed_by_redaction": M.redact(text) != text,
        }
    ).withColumn(
        "is_unsafe",
        F.col("asks_for_credentials")
        | F.col("has_digits")
        | F.col("changed_by_redaction"),
    )


def valid_messages(df: DataFrame, column: str = "text") -> DataFrame:
    """Messages of usable length, with the surrounding white space removed."""
    return df.where(M.is_valid_message(F.col(column))).withColumn(
        column, strip(F.col(column))
    )


def route(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]] = support_topics.KEYWORDS,
    priority: Mapping[str, int] = support_topics.PRIORITY,
    column: str = "text",
) -> DataFrame:
    return df.withColumn("topic", M.best_topic(F.col(column), keywords, priority))


def with_follow_up(
    df: DataFrame,
    shapes: Sequence[str] = support_topics.FOLLOW_UP_SHAPES,
    column: str = "text",
) -> DataFrame:
    return df.withColumn(
        "is_follow_up", M.matches_whole(casefold(strip(F.col(column))), shapes)
    )


def carry_forward(
    routed: DataFrame,
    block_turns: int = BLOCK_TURNS,
    said: str = "topic",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Give unrouted follow-ups the topic of the latest routed user message.

    Looks at the ten messages before, of any role. Takes (conv_id, turn, role,
    topic, is_follow_up) and returns the user messages with resolved_topic, and
    the columns to ``keep``. ``said`` is the topic a message has for later ones.

    A conversation is cut into blocks of turns and each block also receives
    the last ten messages before it, so a very long conversation spreads over
    as many tasks as it has blocks and the result is the same as over one
    window per conversation.
    """
    marked = routed.select(
        "conv_id",
        "turn",
        "role",
        "topic",
        "is_follow_up",
        F.floor(F.col("turn") / block_turns).alias("_block"),
        F.when(F.col("role") == "user", F.col(said)).alias("_said"),
        F.lit(True).alias("_own"),
        *keep,
    )
    in_block = Window.partitionBy("conv_id", "_block")
    tails = (
        marked.withColumn(
            "_back", F.row_number().over(in_block.orderBy(F.desc("turn")))
        )
        .where(F.col("_back") <= HISTORY)
        .groupBy("conv_id", "_block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "_said"))).alias("_tail"))
    )
    earlier = (
        Window.partitionBy("conv_id").orderBy("_block").rowsBetween(-HISTORY, -1)
    )
    before = F.flatten(F.collect_list("_tail").over(earlier))
    halo = (
        tails.select("conv_id", "_block", before.alias("_before"))
        .select(
            "conv_id",
            "_block",
            F.inline(
                F.slice(
                    "_before",
                    F.greatest(F.size("_before") - (HISTORY - 1), F.lit(1)),
                    F.lit(HISTORY),
                )
            ),
        )
        .withColumn("_own", F.lit(False))
    )
    recent = in_block.orderBy("turn").rowsBetween(-HISTORY, -1)
    carried = F.last("_said", ignorenulls=True).over(recent)
    return (
        marked.unionByName(halo, allowMissingColumns=True)
        .withColumn("_carried", carried)
        .where(F.col("_own") & (F.col("role") == "user"))
        .select(
            "conv_id",
            "turn",
            "topic",
            "is_follow_up",
            F.coalesce(
                "topic", F.when(F.col("is_follow_up"), F.col("_carried"))
            ).alias("resolved_topic"),
            *keep,
        )
    )


def answer_variants(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]] = support_topics.VARIANTS,
    topic: str = "topic",
    column: str = "text",
) -> DataFrame:
    """Label of the specialised answer, "general" for routed text without one."""
    special = M.first_matching(F.col(topic), casefold(F.col(column)), rules)
    return df.withColumn(
        "variant",
        F.when(F.col(topic).isNotNull(), F.coalesce(special, F.lit("general"))),
    )


def repeated_questions(df: DataFrame) -> DataFrame:
    """User messages with a flag for text already asked in the conversation.

    The question is stripped and redacted, earlier messages are taken as they
    were written; both are case-folded and compared by digest. Only the first
    turn of every earlier text is joined, so a text that is repeated very often
    meets one row, and Spark splits its own rows over several tasks.
    """
    user = df.where((F.col("role") == "user") & F.col("text").isNotNull())
    said = user.select("conv_id", "turn", _asked_digest(M.redact(strip(F.col("text")))))
    return _with_repeats(said, df).select("conv_id", "turn", "is_repeat")


def _asked_digest(question: Column) -> Column:
    return F.sha2(casefold(question), 256).alias("_digest")


def _with_repeats(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, _digest, ...) with a flag for texts said before in ``df``.

    Rows stay as they are, also those of one turn; a null conversation is one too.
    """
    user = df.where((F.col("role") == "user") & F.col("text").isNotNull())
    first = (
        user.select(F.col("conv_id").alias("_conv"), "turn", _asked_digest(F.col("text")).alias("_said"))
        .groupBy("_conv", "_said")
        .agg(F.min("turn").alias("_first"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_said"))
    return rows.join(first, same, "left").withColumn(
        "is_repeat", F.coalesce(F.col("_first") < F.col("turn"), F.lit(False))
    )


def support_answers(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]] = support_topics.KEYWORDS,
    priority: Mapping[str, int] = support_topics.PRIORITY,
    shapes: Sequence[str] = support_topics.FOLLOW_UP_SHAPES,
    rules: Sequence[tuple[str, str, str]] = support_topics.VARIANTS,
) -> DataFrame:
    """What each user message is answered with, by the whole chain.

    A question is stripped and redacted, then routed; a follow-up that names no
    topic takes the one of the conversation, and the variant is that of the
    resolved topic. Earlier messages count as they were written. Messages of
    unusable length get no answer, but later ones still look back at them.
    Labels are found per topic beforehand, so no text passes the windows.
    """
    raw = F.col("text")
    read = df.withColumns(
        {
            "_usable": M.is_valid_message(raw),
            "_said_topic": M.best_topic(raw, keywords, priority),
            "_asked": M.redact(strip(raw)),
        }
    ).withColumn("_digest", _asked_digest(F.col("_asked")))
    routed = with_follow_up(
        route(read, keywords, priority, "_asked"), shapes, "_asked"
    )
    folded = casefold(F.col("_asked"))
    topics = dict.fromkeys(topic for topic, _, _ in rules)
    labels = F.array(
        *[
            F.struct(
                F.lit(topic).alias("topic"),
                M.first_matching(F.lit(topic), folded, rules).alias("label"),
            )
            for topic in topics
        ]
    )
    carried = carry_forward(
        routed.withColumn("_labels", F.map_from_entries(labels)),
        said="_said_topic",
        keep=("_labels", "_usable", "_digest"),
    ).where("_usable")
    resolved = F.col("resolved_topic")
    special = F.try_element_at("_labels", resolved)
    return _with_repeats(carried, df).select(
        "conv_id",
        "turn",
        "resolved_topic",
        F.when(resolved.isNotNull(), F.coalesce(special, F.lit("general"))).alias("variant"),
        "is_repeat",
    )


def with_answers(routed: DataFrame, articles: DataFrame) -> DataFrame:
    """Attach the stored answer of the routed topic."""
    return routed.join(articles.select("topic", "answer"), "topic", "left")
