import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paygrain.functions import messages as M
from paygrain.operators import mentions, messages, privacy
from paygrain.operators.quality import knowledge_base_violations
from paygrain.sources import support_topics
from tests.conftest import rows


def one(spark, text, expression):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(expression(F.col("text")).alias("v")).first().v


def test_redaction(spark):
    secrets = {
        "card": "5500 0000 0000 0004",
        "CVV": "987",
        "OTP": "445566",
        "password": "hunter2",
        "name": "Asha Rao",
        "transaction reference": "RF-77-X",
        "mail": "asha.rao@example.net",
        "phone": "+1 (415) 555-0132",
    }
    text = (
        f"Card {secrets['card']}; CVV: {secrets['CVV']}; otp is {secrets['OTP']}; "
        f"password {secrets['password']}; my name is {secrets['name']}, "
        f"transaction reference: {secrets['transaction reference']}; "
        f"write to {secrets['mail']} or ring {secrets['phone']}!"
    )
    redacted = one(spark, text, M.redact)
    for private in secrets.values():
        assert private not in redacted
    for marker in ("[REDACTED]", "[REDACTED EMAIL]", "[REDACTED NUMBER]", "[REDACTED PHONE]"):
        assert marker in redacted


def python_redact(text):
    for pattern, marker in M.REDACTIONS:
        text = re.sub(pattern, marker, text, flags=re.IGNORECASE)
    return text


def test_redaction_matches_python_on_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pairs = docs.withColumn("safe", M.redact(F.col("text"))).collect()
    assert any(r.safe != r.text for r in pairs)
    assert all(r.safe == python_redact(r.text) for r in pairs)


PARTS = st.sampled_from(
    ["CVV", "pin", "otp:", " is ", "é", "ß", "12", "4111 1111", "-", "+", "(", ")", " ",
     "a@b.co", "name:", "Zoë", ",", ";", "\n", "0123456789", "٣", "never ", "share your "]
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), min_size=20, max_size=20))
def test_expressions_match_python_on_odd_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    text = F.col("text")
    got = df.select(
        "n",
        M.redact(text).alias("safe"),
        M.asks_for_credentials(text).alias("asks"),
        M.has_digits(text).alias("digits"),
    ).collect()
    for row in got:
        source = texts[row.n]
        assert row.safe == python_redact(source)
        assert row.asks == bool(re.search(M.CREDENTIAL_REQUEST, source, re.IGNORECASE))
        assert row.digits == any(ch.isdigit() for ch in source)


def test_every_digit_counts(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, text string")
    got = df.where(M.has_digits(F.col("text"))).select("c").collect()
    assert {r.c for r in got} == {c for c in codes if chr(c).isdigit()}


@pytest.mark.parametrize(
    "text, unsafe",
    [
        ("Please share your CVV", True),
        ("Never share your CVV", False),
        ("do not share your PIN", False),
        ("don't enter password", False),
        ("Call in 5 minutes", True),
        ("Mail a@example.org", True),
        ("All is well", False),
    ],
)
def test_unsafe_text(spark, text, unsafe):
    df = spark.createDataFrame([(text,)], "text string")
    assert messages.unsafe_flags(df).first().is_unsafe is unsafe


def test_valid_messages(spark):
    texts = ["", "   ", "x" * 501, "  " + "x" * 500 + "\n", None, "  What failed?  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    got = [(r["n"], r["text"]) for r in rows(messages.valid_messages(df), "n")]
    assert got == [(3, "x" * 500), (5, "What failed?")]


@pytest.mark.parametrize(
    "text, topic",
    [
        ("My payment failed", "failed_payment"),
        ("My payment is pending", "pending_payment"),
        ("How do I get a refund?", "refund"),
        ("How can I troubleshoot this payment?", "troubleshooting"),
        ("How do I make a complaint?", "complaint"),
        ("The bank declined it", "failed_payment"),
        ("They charged me and it did not go through", "failed_payment"),
        ("I was charged twice yesterday", "debited_without_success"),
        ("Strange: the merchant did not receive the money", "debited_without_success"),
        ("There is an unrecognized charge here", "complaint"),
        ("a charge I don't recognize", "complaint"),
        ("prepayments", None),
        ("Tell me something unrelated.", None),
    ],
)
def test_routing(spark, text, topic):
    df = spark.createDataFrame([(text,)], "text string")
    assert messages.route(df).first().topic == topic


def python_topic(text, table, priority):
    lower, found = text.casefold(), []
    for topic, words in table.items():
        score = sum(
            max(1, len(w.split()))
            for w in words
            if re.search(rf"\b{re.escape(w.casefold())}\b", lower)
        )
        if score:
            found.append((score, topic))
    if not found:
        return None
    return max(found, key=lambda item: (item[0], priority.get(item[1], 0)))[1]


def test_routing_matches_brute_force(spark):
    rng = random.Random(7)
    words = [w for group in support_topics.KEYWORDS.values() for w in group] + [
        "and", "the", "Über", "pre", "s", "?", "."
    ]
    texts = [
        "".join(rng.choice(words) + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(1, 6)))
        for _ in range(300)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for row in messages.route(df).collect():
        assert row.topic == python_topic(
            row.text, support_topics.KEYWORDS, support_topics.PRIORITY
        ), row.text


def conversation(spark, *turns):
    data = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def resolved(df, **kwargs):
    routed = messages.with_follow_up(messages.route(df))
    return {r.turn: r.resolved_topic for r in messages.carry_forward(routed, **kwargs).collect()}


def test_follow_ups_take_the_earlier_topic(spark):
    df = conversation(
        spark,
        ("user", "My payment is still pending."),
        ("assistant", "My refund is ready."),
        ("user", "And what should I do next?"),
        ("user", "Should I retry?"),
        ("user", "Tell me a joke and explain outer space."),
    )
    assert resolved(df) == {
        0: "pending_payment",
        2: "pending_payment",
        3: "pending_payment",
        4: None,
    }


def test_only_ten_messages_count(spark):
    filler = [("assistant", "Fine.")] * 10
    near = conversation(spark, ("user", "refund"), *filler[:9], ("user", "What about it?"))
    far = conversation(spark, ("user", "refund"), *filler, ("user", "What about it?"))
    assert resolved(near)[10] == "refund"
    assert resolved(far)[11] is None


def test_blocks_do_not_change_the_carried_topic(spark):
    rng = random.Random(3)
    texts = ["refund", "My payment failed", "What about it?", "Hello", "And it?"]
    data, turn = [], {1: 0, 2: 0}
    for _ in range(240):
        conv = 1 if rng.random() < 0.8 else 2
        turn[conv] += rng.choice([1, 1, 2, 9, 40])
        data.append((conv, turn[conv], rng.choice(["user", "user", "assistant"]), rng.choice(texts)))
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    routed = messages.with_follow_up(messages.route(df))

    def run(width):
        return [tuple(r.values()) for r in rows(messages.carry_forward(routed, width), "conv_id", "turn")]

    whole = run(1_000_000)
    assert any(r[2] is None and r[4] is not None for r in whole)
    assert run(3) == whole
    assert run(25) == whole


@pytest.mark.parametrize(
    "text, label",
    [
        ("My payment failed but I was charged", "failed_and_debited"),
        ("Why was it declined", "failed_reason"),
        ("It is pending, can I retry", "pending_retry"),
        ("pending for how long", "pending_timing"),
        ("When do I see my money back", "refund_timing"),
        ("Please issue that refund", "refund_process"),
        ("refund please", "general"),
        ("unrelated", None),
    ],
)
def test_answer_variants(spark, text, label):
    df = spark.createDataFrame([(text,)], "text string")
    assert messages.answer_variants(messages.route(df)).first().variant == label


def test_repeated_questions(spark):
    df = conversation(
        spark,
        ("user", "Where is my REFUND?"),
        ("assistant", "where is my refund?"),
        ("user", " where is my refund? "),
        ("user", "My CVV 123 failed"),
        ("user", "my cvv 456 failed"),
        ("user", "new"),
    )
    got = {r.turn: r.is_repeat for r in messages.repeated_questions(df).collect()}
    assert got == {0: False, 2: True, 3: False, 4: False, 5: False}


def answers(spark, *turns):
    got = messages.support_answers(conversation(spark, *turns)).collect()
    return {r.turn: (r.resolved_topic, r.variant, r.is_repeat) for r in got}


def test_support_chain(spark):
    assert answers(
        spark,
        ("user", "My payment is pending."),
        ("assistant", "A pending status can be confusing."),
        ("user", " And what about how long? "),
        ("user", "MY payment is pending. "),
        ("user", "x" * 501),
        ("user", "Tell me a joke."),
    ) == {
        0: ("pending_payment", "general", False),
        2: ("pending_payment", "pending_timing", False),
        3: ("pending_payment", "general", True),
        5: (None, None, False),
    }


def test_private_words_do_not_route_a_question(spark):
    assert answers(spark, ("user", "my name is failed payment")) == {0: (None, None, False)}
    # Earlier messages are taken as they were written.
    got = answers(spark, ("user", "my name is failed payment"), ("user", "what about it"))
    assert got[1][0] == "failed_payment"


def test_different_numbers_are_different_questions(spark):
    got = answers(
        spark,
        ("user", "is 4111 1111 1111 1111 charged"),
        ("user", "is 5500 0000 0000 0004 charged"),
        ("user", "is [REDACTED NUMBER] charged"),
        ("user", "is 4111 1111 1111 1111 charged"),
    )
    assert [got[i][2] for i in range(4)] == [False, False, False, True]


def test_mentions_match_brute_force(spark):
    rng = random.Random(5)
    names = ["Axis Bank", "Health & Wellness", "Shanker, Lalla and Bora", "a", "Re",
             "Retail", "retail partners", "Supplier#000000012", "Supplier#000000013", "&"]
    words = ["axis", "bank", "Health", "wellness", "&", "shanker", "Lalla", "and", "bora",
             "retailers", "Supplier#000000012", "supplier", "000000013", "xyz", "Über"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    texts.append("axisbank AXIS  bank! health,wellness; Shanker Lalla and Boras")
    messages_df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    names_df = spark.createDataFrame([("x", n) for n in names], "kind string, name string")
    got = {
        (r["n"], r["name"])
        for r in mentions.entity_mentions(messages_df, names_df, ["n"]).collect()
    }

    def form(text):
        return re.sub(r"[^\w%]+", " ", text.casefold()).strip()

    expected = {
        (i, n) for i, t in enumerate(texts) for n in names if form(n) and form(n) in form(t)
    }
    assert got == expected and got
    listed = mentions.listed_mentions(messages_df, "x", names, ["n"]).collect()
    assert {(r["n"], r["name"]) for r in listed} == expected


def test_nested_private_fields(spark):
    df = spark.createDataFrame(
        [
            (
                "call +1 212 555 0199 now",
                "secret value",
                {"Customer_ID": "C1", "note": "pin 1234"},
                [{"cvv": "123", "city": "Pune"}],
                ("x", "CVV 999"),
            )
        ],
        "note string, OTP string, extras map<string,string>, "
        "items array<struct<cvv: string, city: string>>, "
        "who struct<Email: string, remark: string>",
    )
    safe = privacy.sanitize(df)
    assert safe.columns == ["note", "extras", "items", "who"]
    row = safe.first()
    assert "212" not in row["note"]
    assert row["extras"] == {"note": "[REDACTED]"}
    assert [i.asDict() for i in row["items"]] == [{"city": "Pune"}]
    assert row["who"].asDict() == {"remark": "[REDACTED]"}


def test_knowledge_base(spark, tmp_path):
    path = tmp_path / "kb.json"
    path.write_text(
        '{"refund": {"keywords": ["refund"], "answer": "Ask."},\n'
        ' "broken": {"keywords": "x"}}'
    )
    articles = support_topics.read_articles(spark, str(path))
    found = {r.check: r.violations for r in knowledge_base_violations(articles).collect()}
    assert found["answer"] == 1 and found["keywords"] >= 1 and found["no_articles"] == 0
    good = articles.where("topic = 'refund'")
    assert support_topics.keywords_of(good) == {"refund": ("refund",)}
    routed = messages.route(
        spark.createDataFrame([("A refund?",)], "text string"),
        support_topics.keywords_of(good),
    )
    assert messages.with_answers(routed, good).first().answer == "Ask."
    empty = knowledge_base_violations(articles.where("false")).collect()
    assert {r.check for r in empty if r.violations} == {"no_articles"}
