"""Expressions over message text: redaction, safety, routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paygrain.functions.values import bind, casefold, strip

MAX_MESSAGE_CHARS = 500

# What is redacted, in this order, and by which marker.
REDACTIONS = (
    (
        r"\b(?:my name|name|address|account number|transaction id|"
        r"transaction reference|reference number)\s*(?:is|:|=)\s*[^,;]+",
        "[REDACTED]",
    ),
    (
        r"\b(?:cvv|cvc|security code|pin|otp|password|one[- ]time password)\b"
        r"\s*(?:is|:|=)?\s*[A-Za-z0-9-]+",
        "[REDACTED]",
    ),
    (r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED EMAIL]"),
    (r"\b(?:\d[ -]?){11,18}\d\b", "[REDACTED NUMBER]"),
    (r"\b(?:\+?\d[ ().-]*){10,15}\b", "[REDACTED PHONE]"),
)
CREDENTIAL_REQUEST = (
    r"(?<!never )(?<!not )(?<!don't )\b(?:share|send|provide|enter|"
    r"tell me|give me|confirm)\s+(?:your\s+)?"
    r"(?:card number|card details|cvv|cvc|pin|otp|password)\b"
)
PRIVATE_FIELDS = (
    "card",
    "card_id",
    "card_number",
    "cardholder_name",
    "cvv",
    "customer",
    "customer_id",
    "customer_address",
    "customer_email",
    "customer_name",
    "email",
    "email_address",
    "first_name",
    "last_name",
    "mobile",
    "history",
    "phone_number",
    "pan",
    "password",
    "pin",
    "phone",
    "question",
    "otp",
    "account_number",
    "account_id",
    "bank_account",
    "transaction_id",
    "transaction_reference",
    "token",
    "secret",
    "cvv2",
)

# Case-insensitive, with letters, digits and word edges of every alphabet.
_ANY_CASE = "(?iU)"
_UNICODE = "(?U)"

_DECIMAL = r"\p{Nd}"
# Superscript, subscript, enclosed and a few historic digits count as digits too.
_OTHER_DIGIT = (
    r"[²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒\x{1369}-\x{1371}\x{19DA}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)
_NEAR_OTHER_DIGIT = r"[²³¹⁰-₉①-➒\x{1369}-\x{1371}\x{19DA}\x{10A40}-\x{1F10A}]"

# What a text must contain before the costly pattern is tried on it: a mark for
# e-mail addresses, a digit for card and phone numbers.
_NEEDS = (None, None, "@", _DECIMAL, _DECIMAL)
# First letters of a request: one look ahead spares the three looks behind.
_REQUEST_START = "(?=[cegpst])"


def _replaced(text: Column, pattern: str, marker: str, needed: str | None) -> Column:
    def replace(before: Column) -> Column:
        return F.regexp_replace(before, _ANY_CASE + pattern, F.lit(marker))

    if needed is None:
        return replace(text)
    return bind(
        text,
        lambda before: F.when(before.rlike(needed), replace(before)).otherwise(before),
    )


def redact(text: Column) -> Column:
    for (pattern, marker), needed in zip(REDACTIONS, _NEEDS):
        text = _replaced(text, pattern, marker, needed)
    return text


def asks_for_credentials(text: Column) -> Column:
    return text.rlike(_ANY_CASE + _REQUEST_START + CREDENTIAL_REQUEST)


def has_digits(text: Column) -> Column:
    # The wide range is quick to rule out; the exact one only settles the rest.
    other = text.rlike(_NEAR_OTHER_DIGIT) & text.rlike(_OTHER_DIGIT)
    return text.rlike(_DECIMAL) | other


def is_valid_message(text: Column) -> Column:
    """Text of 1 to 500 characters once stripped; null is not valid."""
    return F.coalesce(
        F.length(strip(text)).between(1, MAX_MESSAGE_CHARS), F.lit(False)
    )


def contains_term(folded: Column, term: str) -> Column:
    """Whether the term occurs on word edges. The cheap test goes first."""
    return folded.contains(term) & folded.rlike(
        _UNICODE + r"\b\Q" + term + r"\E\b"
    )


def topic_score(folded: Column, keywords: Sequence[str]) -> Column:
    """Sum of the word counts of the keywords found; ``folded`` is case-folded."""
    score = F.lit(0)
    for keyword in keywords:
        weight = max(1, len(keyword.split()))
        found = contains_term(folded, keyword.casefold())
        score = score + F.when(found, weight).otherwise(0)
    return score


def best_topic(
    text: Column,
    keywords: Mapping[str, Sequence[str]],
    priority: Mapping[str, int] | None = None,
) -> Column:
    """The topic with the best score, then priority, then first listed; or null.

    The keyword table is configuration, so it becomes one expression per topic:
    no join, no shuffle, and no candidate rows however many messages match.
    """
    folded = casefold(text)
    priority = priority or {}
    candidates = F.array(
        *[
            F.struct(
                topic_score(folded, words).alias("score"),
                F.lit(priority.get(topic, 0)).alias("priority"),
                F.lit(-position).alias("order"),
                F.lit(topic).alias("topic"),
            )
            for position, (topic, words) in enumerate(keywords.items())
        ]
    )
    best = F.array_max(candidates)
    return F.when(best.getField("score") > 0, best.getField("topic"))


def matches_whole(folded: Column, shapes: Sequence[str]) -> Column:
    """Whether the whole case-folded text has one of the shapes."""
    found = F.lit(False)
    for shape in shapes:
        found = found | folded.rlike(_UNICODE + r"\A(?:" + shape + r")\z")
    return found


def first_matching(
    topic: Column, folded: Column, rules: Sequence[tuple[str, str, str]]
) -> Column:
    """Label of the first (topic, pattern, label) rule that applies, or null."""
    label = None
    for wanted, pattern, name in rules:
        applies = (topic == wanted) & folded.rlike(_UNICODE + pattern)
        label = (
            F.when(applies, F.lit(name))
            if label is None
            else label.when(applies, F.lit(name))
        )
    return label if label is not None else F.lit(None).cast("string")


def name_form(text: Column) -> Column:
    """Case-folded words separated by single blanks, for matching names."""
    return F.trim(
        F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_%]+", F.lit(" "))
    )
