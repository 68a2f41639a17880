"""Support keyword table and routing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrain import model

# Topics, their keywords, their priority on equal scores, the
# shapes of a follow-up question and the rules that pick an answer variant.
KEYWORDS = {
    "failed_payment": (
        "failed",
        "failure",
        "declined",
        "decline",
        "rejected",
        "didn't go through",
        "did not go through",
        "not successful",
        "unsuccessful payment",
        "failed transaction",
        "card transaction failed",
        "no successful payment",
        "money taken",
    ),
    "debited_without_success": (
        "debited but",
        "debited",
        "money deducted",
        "money was deducted",
        "amount deducted",
        "amount was debited",
        "charged but",
        "charged twice",
        "duplicate charge",
        "account was debited",
        "deducted without",
        "deducted but no order",
        "debited but no order",
        "paid but order",
        "paid but no confirmation",
        "no confirmation",
        "merchant did not receive",
        "merchant didn't receive",
        "order not received",
    ),
    "pending_payment": (
        "pending",
        "pending charge",
        "processing",
        "not completed",
        "still processing",
        "awaiting confirmation",
        "waiting for confirmation",
        "in progress",
        "stuck",
    ),
    "refund": (
        "refund",
        "refund status",
        "refund not received",
        "refund not arrived",
        "track refund",
        "refund timeframe",
        "refund approved",
        "money back",
        "money has not returned",
        "reversal",
        "reimburse",
        "return my money",
    ),
    "payment_faq": ("payment", "pay", "charge", "transaction", "help"),
    "troubleshooting": (
        "troubleshoot",
        "troubleshooting",
        "error",
        "not working",
        "issue",
        "problem",
    ),
    "complaint": (
        "complaint",
        "complain",
        "dispute",
        "unauthorized payment",
        "unrecognized charge",
        "charge I don't recognize",
        "complaint process",
        "raise a concern",
        "report a problem",
    ),
}
PRIORITY = {
    "debited_without_success": 6,
    "failed_payment": 5,
    "pending_payment": 4,
    "refund": 3,
    "complaint": 2,
    "troubleshooting": 1,
    "payment_faq": 0,
}
FOLLOW_UP_SHAPES = (
    r"(?:and\s+)?(?:what|how)\s+(?:about|should|do|does|long|soon|when)\b[^\n]*",
    r"(?:and\s+)?(?:it|that|there|then|those|them)\b[^\n]*",
    r"(?:and\s+)?(?:should|can|could|do|will)\s+(?:i|we|they|it|that)\b[^\n]*",
)
VARIANTS = (
    ("failed_payment", r"\b(?:debit|deduct|charged|taken)\w*\b", "failed_and_debited"),
    ("failed_payment", r"\b(?:why|reason|cause)\b", "failed_reason"),
    ("pending_payment", r"\b(?:retry|again|pay again|duplicate)\b", "pending_retry"),
    ("pending_payment", r"\b(?:how long|when|time)\b", "pending_timing"),
    ("refund", r"\b(?:when|how long|time|status|where)\b", "refund_timing"),
    ("refund", r"\b(?:process|issue|initiate|give me)\b", "refund_process"),
)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(topic, keywords, answer) rows from a JSON object keyed by topic.

    The file is one small object; it is parsed as a map so that any topic name
    is accepted and malformed articles show up as nulls for the shape checks.
    """
    article = "map<string, struct<keywords: array<string>, answer: string>>"
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", article).alias("articles")
    )
    rows = parsed.select(F.explode("articles").alias("topic", "article"))
    return rows.select("topic", "article.keywords", "article.answer").to(
        model.KNOWLEDGE_BASE
    )


def keywords_of(articles: DataFrame) -> dict[str, tuple[str, ...]]:
    """The keyword table of a knowledge base, as the routing expressions need it.

    This reads the articles to the driver: they are configuration that a person
    wrote, a page of text, not data that grows.
    """
    rows = articles.select("topic", "keywords").toLocalIterator()
    return {row.topic: tuple(row.keywords) for row in rows}
