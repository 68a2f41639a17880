
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import (
    FOLLOW_UP,
    LISTED_NAMES,
    ORACLES,
    TOPIC_PRIORITY,
    TOPIC_WORDS,
    VARIANT_RULES,
)
from paygrain.operators import (
    anomalies,
    cleaning,
    enrichment,
    filters,
    generation,
    measures,
    mentions,
    messages,
    privacy,
    quality,
    rankings,
)
from paygrain.plans import reports, rollups, snapshot
from paygrain.sources import orders_feed as feed

# The pipeline operators are a part of their own: without it, all else works. An import
# that fails inside it is an error.
try:
    import corpus_pipeline  # noqa: F401
    import paygrain.llm.queries as llm
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "paygrain.llm", "paygrain.llm.queries"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

# The dashboard selection used by the queries that take one.
CATEGORIES = ("Travel", "Grocery", "Retail")
BANKS = ("HDFC Bank", "Axis Bank")


def entry(spark: SparkSession) -> DataFrame:
    """Merchants that fail more often than the whole table."""
    return queries()["merchant_risk"](spark, "/root/testdata/sf0.001")


def _on_fact(report: Callable[[DataFrame], DataFrame], **lookups: bool) -> Query:
    return lambda spark, sf: report(feed.transactions(spark, sf, **lookups))


def _on_selection(report: Callable[[DataFrame], DataFrame], **lookups: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tx = feed.transactions(spark, sf, card=True, **lookups)
        return report(filters.filter_in(tx, CATEGORIES, banks=BANKS))

    return run


def _on_snapshot(answer: Callable[[DataFrame], DataFrame], **lookups: bool) -> Query:
    """A snapshot answer with the lookups it reads; names it does not read are null."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        tx = feed.transactions(spark, sf, **lookups)
        for name in ("bank_name", "merchant_name"):
            if name not in tx.columns:
                tx = tx.withColumn(name, F.lit(None).cast("string"))
        return answer(cleaning.snapshot_rows(tx))

    return run


def _plain_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.col("amount").cast("double"))


def _rollup(tx: DataFrame) -> DataFrame:
    totals = rollups.rollup(tx)
    return totals.withColumns(
        {name: F.col(name).cast("double") for name in ("amount", "squares", "done_amount")}
    )


def _all_grains(rows: DataFrame) -> DataFrame:
    """Metrics a grain does not have are -1 here: counts stay whole numbers."""
    return snapshot.all_grains(rows).fillna(
        -1, ["completed_transactions", "success_rate", "failure_rate"]
    )


def _scored(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, F.round("amount_z_score", 6).alias("amount_z_score"), "amount_anomaly"
    )


def _with_shops(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    shops = feed.merchants(spark, sf).select(
        "merchant_id",
        "merchant_name",
        F.col("city").alias("merchant_city"),
        F.col("state").alias("merchant_state"),
    )
    return lambda rows: rows.join(shops, "merchant_id", "left")


def _page(spark: SparkSession, sf: str) -> DataFrame:
    tx = feed.transactions(spark, sf, card=True)
    chosen = filters.filter_ci(tx, " health & wellness", "COMPLETED", "axis bank ")
    shops = _with_shops(spark, sf)
    return _plain_amount(filters.page(chosen, limit=50, offset=100, complete=shops))


def _deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """Bank and card of the page's rows only, too; no filter reads them."""
    tx = feed.transactions(spark, sf)
    orders = feed.table(spark, sf, "orders")
    shops = _with_shops(spark, sf)
    return _plain_amount(
        filters.page(
            tx,
            limit=100,
            offset=20_000,
            complete=lambda rows: shops(feed.with_card(rows, orders)),
        )
    )


def _fact_anomalies(tx: DataFrame) -> DataFrame:
    flagged = anomalies.amount_anomalies(tx.select("transaction_id", "amount"), 1.7)
    return _scored(_plain_amount(flagged), "transaction_id", "amount")


def _event_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    events = feed.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value"
    )
    flagged = anomalies.amount_anomalies(events, column="value", key="event_id")
    return _scored(flagged, "event_id", "user_id", "event_type", "value")


def _amount_spread(tx: DataFrame) -> DataFrame:
    return measures.spread(tx, "amount").select(
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


def _document_customers(tx: DataFrame) -> DataFrame:
    return reports.document_customers(tx).withColumn(
        "categories", F.array_join("categories", ",")
    )


def _first_copies(spark: SparkSession, sf: str) -> DataFrame:
    lines = feed.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_shipdate",
    )
    return cleaning.keep_first(
        lines,
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"],
    ).drop("l_shipdate")


def _star(spark: SparkSession, sf: str) -> DataFrame:
    tx = feed.transactions(spark, sf, card=True).select(
        "transaction_id", "customer_id", "card_id", "merchant_id", "amount"
    )
    return _plain_amount(
        enrichment.star(
            tx,
            feed.customers(spark, sf),
            feed.cards(spark, sf),
            feed.merchants(spark, sf),
        )
    )


def _row_counts(spark: SparkSession, sf: str) -> DataFrame:
    tables = feed.clean_tables(spark, sf) | {"transactions": feed.transactions(spark, sf)}
    tables["cards_public"] = tables.pop("cards")
    tables["transactions_clean"] = tables.pop("transactions")
    return measures.row_counts(tables)


def _clean_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rule_counts(feed.clean_tables(spark, sf)).drop("detail")


def _damaged_quality(spark: SparkSession, sf: str) -> DataFrame:
    tables = feed.damaged_tables(spark, sf, **feed.EVERY_LOOKUP)
    return quality.violations(tables).drop("detail")


def _damaged(
    check: Callable[[dict[str, DataFrame]], DataFrame], **lookups: bool
) -> Query:
    """A check of the damaged tables; transactions have the lookups it reads."""
    return lambda spark, sf: check(feed.damaged_tables(spark, sf, **lookups))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return messages.with_follow_up(
        messages.route(
            feed.table(spark, sf, "conversations"), TOPIC_WORDS, TOPIC_PRIORITY
        ),
        FOLLOW_UP,
    )


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    sites = (
        feed.table(spark, sf, "pages")
        .select(
            F.lit("site").alias("kind"),
            F.regexp_extract("url", r"^https?://([^./]+)", 1).alias("name"),
        )
        .distinct()
    )
    return mentions.entity_mentions(
        feed.table(spark, sf, "conversations"), sites, ["conv_id", "turn"]
    )


# Accented letters, masked before comparing redacted texts: see the SQL.
ACCENTED = "[ªµºÀ-ÖØ-öø-ɏ]"


def _redaction_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: markers by kind, length and digest of the redacted text."""
    redacted = messages.redact(
        feed.table(spark, sf, "documents").select("doc_id", "text")
    )
    text = F.col("text")
    return redacted.select(
        "doc_id",
        F.regexp_count(text, F.lit(r"\[REDACTED\]")).cast("long").alias("values"),
        F.regexp_count(text, F.lit(r"\[REDACTED EMAIL\]")).cast("long").alias("emails"),
        F.regexp_count(text, F.lit(r"\[REDACTED NUMBER\]")).cast("long").alias("numbers"),
        F.regexp_count(text, F.lit(r"\[REDACTED PHONE\]")).cast("long").alias("phones"),
        F.length(text).cast("long").alias("chars"),
        F.md5(F.regexp_replace(text, ACCENTED, "_")).alias("digest"),
    )


def _repeated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as its messages, to find the copies among them."""
    documents = feed.table(spark, sf, "documents").select(
        F.col("source").alias("conv_id"),
        F.col("doc_id").alias("turn"),
        F.lit("user").alias("role"),
        "text",
    )
    return messages.repeated_questions(documents).select(
        F.col("conv_id").alias("source"), F.col("turn").alias("doc_id"), "is_repeat"
    )


def _sanitized(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested documents, private fields dropped at any depth."""
    nested = feed.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.struct(
            F.col("text").alias("content"),
            F.col("role"),
            F.concat(F.lit("C"), F.col("conv_id")).alias("customer_id"),
        ).alias("message"),
        F.array(
            F.struct(F.col("text").alias("question"), F.col("role").alias("speaker"))
        ).alias("log"),
    )
    return privacy.sanitize(nested).select(
        "conv_id", "turn", "message.*", F.inline("log")
    )


def _synthetic_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Synthetic tables numbered like the given customers and suppliers."""
    owners = generation.customer_rows(
        feed.table(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("id")),
        generation.CUSTOMER_SEED,
    )
    shops = generation.merchant_rows(
        feed.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("id")),
        generation.MERCHANT_SEED,
    )
    held = generation.cards(owners)
    return {
        "customers": owners,
        "cards": held,
        "merchants": shops,
        "transactions": generation.transactions(held, owners, shops),
    }


def _synthetic(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _synthetic_tables(spark, sf)[name]
        for money in ("amount", "annual_income"):
            if money in df.columns:
                df = df.withColumn(money, F.col(money).cast("double"))
        return df

    return run


def _synthetic_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rule_counts(_synthetic_tables(spark, sf)).drop("detail")


def queries() -> dict[str, Query]:
    return _reference_queries() | (llm.QUERIES if llm else {})


def _reference_queries() -> dict[str, Query]:
    return {
        # summaries and reports
        "customer_summary": _on_fact(reports.customer_summary, card=True),
        "merchant_summary": _on_fact(reports.merchant_summary, merchant=True),
        "monthly_performance": _on_fact(reports.monthly_performance),
        "category_performance": _on_fact(reports.category_performance),
        "status_distribution": _on_fact(reports.status_distribution),
        "report_rollup": _on_fact(_rollup, card=True, merchant=True),
        # business queries
        "kpi": _on_fact(reports.kpi, card=True),
        "monthly_trend": _on_fact(reports.monthly_trend),
        "category_kpi": _on_fact(reports.category_kpi),
        "top_customers": _on_fact(reports.top_customers, card=True),
        "merchant_risk": _on_fact(reports.merchant_risk, merchant=True),
        "bank_card_mix": _on_fact(reports.bank_card_mix, card=True),
        # listing service
        "service_summary": _on_fact(reports.service_summary, card=True),
        "service_categories": _on_fact(reports.service_categories),
        "service_banks": _on_fact(reports.service_banks, card=True),
        "service_merchants": _on_fact(reports.service_merchants, merchant=True),
        "transaction_page": _page,
        "transaction_deep_page": _deep_page,
        "frequent_method": _on_fact(
            lambda tx: measures.most_frequent(tx, "payment_method")
        ),
        # dashboard
        "dashboard_kpi": _on_fact(
            lambda tx: reports.dashboard_kpi(tx, CATEGORIES, banks=BANKS), card=True
        ),
        "dashboard_monthly": _on_selection(reports.dashboard_monthly),
        "dashboard_categories": _on_selection(reports.dashboard_categories),
        "dashboard_statuses": _on_selection(reports.status_distribution),
        "bank_card_pivot": _on_fact(reports.bank_card_pivot, card=True),
        "dashboard_customers": _on_selection(reports.dashboard_customers),
        "dashboard_failing_merchants": _on_selection(
            reports.dashboard_failing_merchants, merchant=True
        ),
        "latest_transactions": _on_selection(
            lambda tx: _plain_amount(filters.latest_first(tx)), merchant_place=True
        ),
        # snapshot
        "snapshot_overall": _on_snapshot(snapshot.overall),
        "snapshot_banks": _on_snapshot(snapshot.banks, card=True),
        "snapshot_merchants": _on_snapshot(snapshot.merchants, merchant=True),
        "snapshot_categories": _on_snapshot(snapshot.categories),
        "snapshot_months": _on_snapshot(snapshot.months),
        "snapshot_all_grains": _on_snapshot(_all_grains, card=True, merchant=True),
        "snapshot_gate": _on_fact(
            cleaning.snapshot_violations, card=True, merchant=True
        ),
        "snapshot_of_texts": lambda spark, sf: _all_grains(
            cleaning.snapshot_rows(feed.text_snapshot(spark, sf))
        ),
        "damaged_snapshot_gate": lambda spark, sf: cleaning.snapshot_violations(
            feed.text_snapshot(spark, sf, damaged=True)
        ),
        # document-style
        "document_monthly": _on_fact(reports.document_monthly),
        "document_categories": _on_fact(reports.document_categories),
        "document_customers": _on_fact(_document_customers, card=True),
        # measures
        "measures_by_bank": _on_fact(
            lambda tx: measures.measures(tx, "bank_name"), card=True
        ),
        "measures_by_method": _on_fact(
            lambda tx: measures.measures(tx, "payment_method"), card=True
        ),
        "measures_by_state": _on_fact(
            lambda tx: measures.measures(tx, "customer_state"), customer_place=True
        ),
        "measures_by_status": _on_fact(
            lambda tx: measures.measures(tx, "transaction_status"), card=True
        ),
        "measures_overall": _on_fact(measures.measures, card=True),
        # comparison and ranking
        "compare_banks": _on_snapshot(
            lambda rows: rankings.compare(
                snapshot.banks(rows), "bank", currency=snapshot.currency(rows)
            ),
            card=True,
        ),
        "compare_merchants": _on_snapshot(
            lambda rows: rankings.compare(
                snapshot.merchants(rows), "merchant", currency=snapshot.currency(rows)
            ),
            merchant=True,
        ),
        "compare_categories": _on_snapshot(
            lambda rows: rankings.compare(
                snapshot.categories(rows),
                "category",
                ["travel", "Grocery"],
                snapshot.currency(rows),
            )
        ),
        "bank_failures": _on_snapshot(
            lambda rows: rankings.failures(snapshot.banks(rows), "bank", ["axis bank"]),
            card=True,
        ),
        "merchant_failures": _on_snapshot(
            lambda rows: rankings.failures(
                snapshot.merchants(rows), "merchant", then=("category",)
            ),
            merchant=True,
        ),
        "category_failures": _on_snapshot(
            lambda rows: rankings.failures(snapshot.categories(rows), "category")
        ),
        "overall_failures": _on_snapshot(
            lambda rows: rankings.overall_failures(snapshot.overall(rows))
        ),
        "top_bank_by_metric": _on_snapshot(
            lambda rows: rankings.top_banks(snapshot.banks(rows)),
            card=True,
        ),
        "top_merchant_by_metric": _on_snapshot(
            lambda rows: rankings.top_merchants(snapshot.merchants(rows)),
            merchant=True,
        ),
        "top_category_by_metric": _on_snapshot(
            lambda rows: rankings.top_categories(snapshot.categories(rows))
        ),
        "busiest_merchants": _on_snapshot(
            lambda rows: rankings.busiest_merchants(snapshot.merchants(rows)),
            merchant=True,
        ),
        "bank_series": _on_snapshot(
            lambda rows: rankings.series(snapshot.banks(rows), "bank", "success_rate"),
            card=True,
        ),
        "month_series": _on_snapshot(
            lambda rows: rankings.month_series(snapshot.months(rows))
        ),
        # anomalies
        "amount_anomalies": _on_fact(_fact_anomalies),
        "event_value_anomalies": _event_anomalies,
        "amount_spread": _on_fact(_amount_spread),
        # quality
        "quality_of_clean_tables": _clean_quality,
        "quality_of_damaged_tables": _damaged_quality,
        "damaged_invalid_values": _damaged(quality.invalid_values),
        "duplicate_transaction_ids": _damaged(
            lambda t: quality.duplicate_keys(t["transactions"], "transaction_id")
        ),
        "orphan_transactions": _damaged(
            lambda t: quality.orphans(
                t["transactions"].select("transaction_id", "merchant_id"),
                t["merchants"],
                "merchant_id",
            ).select("transaction_id", "merchant_id")
        ),
        "sql_quality_checks": _damaged(quality.sql_checks, card=True),
        "card_preconditions": _damaged(
            lambda t: quality.card_preconditions(t["customers"], t["cards"])
        ),
        "row_counts": _row_counts,
        # fact and dimensions
        "clean_transactions": lambda spark, sf: _plain_amount(
            feed.full_transactions(spark, sf)
        ),
        "first_copies": _first_copies,
        "star_join": _star,
        "public_cards": lambda spark, sf: cleaning.public_cards(
            feed.cards(spark, sf)
        ),
        "merchants_without_contacts": lambda spark, sf: cleaning.without_contacts(
            feed.merchants(spark, sf).drop("balance")
        ),
        "owned_cards": lambda spark, sf: enrichment.owned_cards(
            feed.cards(spark, sf), feed.customers(spark, sf)
        ).select("card_id", "customer_id", "customer_city", "customer_state"),
        # messages
        "redacted_documents": lambda spark, sf: messages.redact(
            feed.table(spark, sf, "documents").select("doc_id", "text")
        ),
        "redaction_profile": _redaction_profile,
        "unsafe_texts": lambda spark, sf: messages.unsafe_flags(
            feed.table(spark, sf, "documents").select("doc_id", "text")
        ).drop("text"),
        "valid_messages": lambda spark, sf: messages.valid_messages(
            feed.table(spark, sf, "conversations")
        ),
        "routed_messages": lambda spark, sf: _routed(spark, sf).select(
            "conv_id", "turn", "topic"
        ),
        "carried_topics": lambda spark, sf: messages.carry_forward(_routed(spark, sf)),
        "answer_variants": lambda spark, sf: messages.answer_variants(
            _routed(spark, sf), VARIANT_RULES
        ).select("conv_id", "turn", "topic", "variant"),
        "repeated_questions": lambda spark, sf: messages.repeated_questions(
            feed.table(spark, sf, "conversations")
        ),
        "repeated_documents": _repeated_documents,
        "support_answers": lambda spark, sf: messages.support_answers(
            feed.table(spark, sf, "conversations"),
            TOPIC_WORDS,
            TOPIC_PRIORITY,
            FOLLOW_UP,
            VARIANT_RULES,
        ),
        "entity_mentions": _mentions,
        "listed_mentions": lambda spark, sf: mentions.listed_mentions(
            feed.table(spark, sf, "documents"), "word", LISTED_NAMES, ["doc_id"]
        ),
        "sanitized_messages": _sanitized,
        # generators numbered by the given tables
        "synthetic_customers": _synthetic("customers"),
        "synthetic_cards": _synthetic("cards"),
        "synthetic_merchants": _synthetic("merchants"),
        "synthetic_transactions": _synthetic("transactions"),
        "quality_of_synthetic_tables": _synthetic_quality,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLES | (llm.ORACLES if llm else {})
