"""Data-quality rules as counts per (rule, dataset, column).

``rule_counts`` reports every rule with its number of violations, 0 included;
``violations`` keeps the broken ones, so an empty result means a clean set.

A table is read once: every row states its keys and the rules it breaks, and all
statements of all tables are counted by one grouping.

Rules: V1 dataset unreadable or rows malformed, V2 required column missing, V3 duplicate key,
V4 missing value, V5 blank key, V6 foreign key, V7 card owner, V8 merchant
category, V9 allowed values, V10 unparseable date, V11 issue before expiry,
V12 date in the future, V13 expiry passed, V14 income, V15 age, V16 amount.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrain import model
from paygrain.functions import values
from paygrain.model import FILE_ORDER, MALFORMED
from paygrain.operators.filters import missing_columns

Tables = dict[str, DataFrame]


# --- row rules: (rule, column, test) per table ------------------------------

RowRule = tuple[str, str, Column]

# Columns of the reader that are no part of a table.
READER_COLUMNS = (MALFORMED, FILE_ORDER)


def _any_missing(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return column.isNull() | values.is_blank(column)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _not(test: Column) -> Column:
    """Rows where the test does not hold, null included."""
    return ~F.coalesce(test, F.lit(False))


def _completeness(name: str, df: DataFrame) -> list[RowRule]:
    rules = [
        ("V4", field.name, _any_missing(field))
        for field in df.schema.fields
        if field.name not in READER_COLUMNS
    ]
    key = model.PRIMARY_KEYS[name]
    rules.append(("V5", key, values.is_blank(F.col(key).cast("string"))))
    return rules


def _contents(name: str, df: DataFrame, reference: date) -> list[RowRule]:
    kinds = {field.name: field.dataType for field in df.schema.fields}
    rules: list[RowRule] = []
    for column, allowed in model.ALLOWED_VALUES.get(name, {}).items():
        value = values.strip(F.col(column))
        rules.append(("V9", column, ~value.isin(*allowed)))
    days = {
        column: values.day_or_null(F.col(column))
        for column in model.DATE_COLUMNS[name]
    }
    rules += [("V10", column, parsed.isNull()) for column, parsed in days.items()]
    future = model.NOT_IN_FUTURE[name]
    rules.append(("V12", future, days[future] > F.lit(reference)))
    if name == "cards":
        rules.append(("V11", "issue_date", days["issue_date"] >= days["expiry_date"]))
        rules.append(("V13", "expiry_date", days["expiry_date"] <= F.lit(reference)))
    if name == "customers":
        income = values.number(F.col("annual_income"), kinds["annual_income"])
        age = values.number(F.col("age"), kinds["age"])
        rules.append(
            ("V14", "annual_income", _not(income.between(*model.INCOME_RANGE)))
        )
        rules.append(("V15", "age", _not(age.between(*model.AGE_RANGE))))
    if name == "transactions":
        amount = values.number(F.col("amount"), kinds["amount"])
        rules.append(("V16", "amount", ~values.positive_finite(amount)))
    return rules


# --- key rules: one grouping for all keys and links ------------------------


class Link(NamedTuple):
    """A key of ``child``, and the table it should be found in, if any."""

    name: str
    child: str
    key: str
    parent: str | None = None
    attribute: str | None = None


def key_counts(
    tables: Tables,
    links: Sequence[Link],
    rules: dict[str, list[RowRule]] | None = None,
) -> DataFrame:
    """One row of counts per link and row rule, from a single pass over each table.

    Every row states the keys it has, as child or as parent, and the rules it
    breaks. The statements are counted per (link, key, attribute), then per
    (link, key), then per link. Nothing is joined, so a key that a third of the
    rows share, null or not, is collapsed before the first shuffle; so are
    broken rules, which have no key. A malformed row states only that (V1).

    rows: statements as child; for a rule the rows that break it.
    repeats: child rows whose key was already taken, nulls equal each other.
    orphans: child rows without a parent; a null key has none.
    mismatches: child rows whose parent does not have their attribute,
    including rows without a parent and null attributes.
    differing_pairs: rows of an inner join on the key whose attributes differ.
    """
    rules = rules or {}
    stated: dict[str, list[Column]] = {name: [] for name in rules}

    def statement(
        link: str, key: Column, attribute: Column, children: int, parents: int
    ) -> Column:
        return F.struct(
            F.lit(link).alias("link"),
            key.cast("string").alias("key"),
            attribute.cast("string").alias("attribute"),
            F.lit(children).alias("c"),
            F.lit(parents).alias("p"),
        )

    nothing = F.lit(None)
    for link in links:
        attribute = F.col(link.attribute) if link.attribute else nothing
        for table, c, p in ((link.child, 1, 0), (link.parent, 0, 1)):
            if table:
                entry = statement(link.name, F.col(link.key), attribute, c, p)
                stated.setdefault(table, []).append(entry)

    def statements(name: str, keys: list[Column]) -> DataFrame:
        df, entries = tables[name], F.array(*keys) if keys else None
        if tests := rules.get(name):
            broken = F.filter(
                F.array(
                    *[
                        F.when(test, statement(f"{rule} {name} {column}", nothing, nothing, 1, 0))
                        for rule, column, test in tests
                    ]
                ),
                lambda entry: entry.isNotNull(),
            )
            # Most rows break no rule: only for others the list is put together.
            any_broken = reduce(or_, [F.coalesce(test, F.lit(False)) for _, _, test in tests])
            no_entry = F.filter(F.array(statement("", nothing, nothing, 0, 0)), lambda _: F.lit(False))
            listed = F.when(any_broken, broken).otherwise(no_entry)
            entries = listed if entries is None else F.concat(entries, listed)
        if MALFORMED in df.columns:
            unread = F.array(statement(f"V1 {name} ", nothing, nothing, 1, 0))
            entries = F.when(F.col(MALFORMED).isNull(), entries).otherwise(unread)
        return df.select(F.inline(entries))

    usable = [
        statements(name, keys).where(F.col("key").isNotNull() | (F.col("p") == 0))
        for name, keys in stated.items()
    ]
    has_attribute = F.col("attribute").isNotNull()
    found = has_attribute & (F.col("parents") > 0)
    per_attribute = (
        reduce(DataFrame.unionByName, usable)
        .groupBy("link", "key", "attribute")
        .agg(F.sum("c").alias("children"), F.sum("p").alias("parents"))
    )
    per_key = per_attribute.groupBy("link", "key").agg(
        F.sum("children").alias("children"),
        F.sum("parents").alias("parents"),
        F.sum(F.when(~found, F.col("children")).otherwise(0)).alias("different"),
        F.sum(F.when(has_attribute, F.col("children")).otherwise(0)).alias("c"),
        F.sum(F.when(has_attribute, F.col("parents")).otherwise(0)).alias("p"),
        F.sum(F.when(has_attribute, _pairs("children", "parents")).otherwise(0)).alias(
            "equal"
        ),
    )
    children = F.col("children")
    counted = per_key.groupBy("link").agg(
        F.sum(children).alias("rows"),
        F.sum(F.greatest(children - 1, F.lit(0))).alias("repeats"),
        F.sum(F.when(F.col("parents") == 0, children).otherwise(0)).alias("orphans"),
        F.sum("different").alias("mismatches"),
        F.sum(_pairs("c", "p") - F.col("equal"))
        .try_cast("long")
        .alias("differing_pairs"),
    )
    # What nothing stated still gets its row of zeros.
    wanted = [link.name for link in links]
    wanted += [f"{rule} {name} {column}" for name in rules for rule, column, _ in rules[name]]
    wanted += [f"V1 {name} " for name in rules if MALFORMED in tables[name].columns]
    zeros = F.struct(*[F.lit(0).cast("long").alias(name) for name in _COUNTS])
    found_counts = F.map_from_entries(
        F.collect_list(F.struct("link", F.struct(*_COUNTS).alias("counts")))
    )
    return (
        counted.agg(found_counts.alias("found"))
        .select("found", F.explode(F.array(*[F.lit(name) for name in wanted])).alias("link"))
        .select("link", F.coalesce(F.try_element_at("found", F.col("link")), zeros).alias("counts"))
        .select("link", "counts.*")
    )


def _pairs(left: str, right: str) -> Column:
    """Product of two counts, wide enough for any pair of tables."""
    wide = "decimal(19,0)"
    return F.col(left).cast(wide) * F.col(right).cast(wide)


_COUNTS = ("rows", "repeats", "orphans", "mismatches", "differing_pairs")


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat a key already seen; nulls equal each other."""
    counts = key_counts({"rows": df}, [Link("key", "rows", key)])
    return counts.select(F.col("repeats").alias("violations"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    )


def link_counts(
    child: DataFrame, parent: DataFrame, key: str, attribute: str | None = None
) -> DataFrame:
    """Orphans and attribute mismatches of one child-to-parent link."""
    link = Link("link", "child", key, "parent", attribute)
    counts = key_counts({"child": child, "parent": parent}, [link])
    return counts.select("orphans", "mismatches")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The child rows themselves that have no parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def matched_mismatches(
    child: DataFrame, parent: DataFrame, key: str, attribute: str
) -> DataFrame:
    """SQL flavour of the owner check: rows without a parent do not count."""
    link = Link("link", "child", key, "parent", attribute)
    counts = key_counts({"child": child, "parent": parent}, [link])
    return counts.select(F.col("differing_pairs").alias("mismatches"))


def invalid_values(tables: Tables) -> DataFrame:
    """Each value outside its domain with its row count, nulls ignored."""
    parts = []
    for dataset, domains in model.ALLOWED_VALUES.items():
        candidates = F.array(
            *[
                F.struct(
                    F.lit(column).alias("column"),
                    values.strip(F.col(column)).alias("value"),
                    values.strip(F.col(column)).isin(*allowed).alias("ok"),
                )
                for column, allowed in domains.items()
            ]
        )
        bad = F.filter(candidates, lambda c: ~c.getField("ok"))
        parts.append(
            tables[dataset]
            .select(F.inline(bad))
            .groupBy(F.lit(dataset).alias("dataset"), "column", "value")
            .agg(F.count(F.lit(1)).alias("row_count"))
        )
    return reduce(DataFrame.unionByName, parts)


# --- the report -----------------------------------------------------------


def _schema_rules(spark, tables: Tables, problems: dict[str, str]) -> DataFrame:
    found = [("V1", name, "", 1, text) for name, text in sorted(problems.items())]
    for name, df in tables.items():
        missing = missing_columns(df, model.REQUIRED_COLUMNS[name])
        found += [
            ("V2", name, column, 1, f"{name} is missing required column {column}")
            for column in missing
        ]
    return spark.createDataFrame(
        found,
        "rule string, dataset string, column string, violations long, detail string",
    )


# (rule for the key, rule for the attribute) of each link between the tables.
LINKS = (
    Link("card_customer", "cards", "customer_id", "customers"),
    Link("transaction_customer", "transactions", "customer_id", "customers"),
    Link("transaction_card", "transactions", "card_id", "cards", "customer_id"),
    Link(
        "transaction_merchant",
        "transactions",
        "merchant_id",
        "merchants",
        "merchant_category",
    ),
)
ATTRIBUTE_RULES = {"transaction_card": "V7", "transaction_merchant": "V8"}


def _counted_rules(
    tables: Tables, rules: dict[str, list[RowRule]], linked: bool
) -> DataFrame:
    """The row rules, V3 for all tables and, for a complete set, V6 to V8.

    An attribute rule has no verdict while the parent key is not unique.
    """
    keys = [Link(name, name, model.PRIMARY_KEYS[name]) for name in tables]
    links = LINKS if linked else ()
    counts = key_counts(tables, [*keys, *links], rules)
    number = F.map_from_entries(F.collect_list(F.struct("link", F.struct(*_COUNTS))))

    def of(link: str, name: str) -> Column:
        return F.try_element_at("counts", F.lit(link))[name]

    rows = []
    for name, tests in rules.items():
        if MALFORMED in tables[name].columns:
            rows.append(("V1", name, "", of(f"V1 {name} ", "rows")))
        for rule, column, _ in tests:
            rows.append((rule, name, column, of(f"{rule} {name} {column}", "rows")))
    rows += [("V3", key.child, key.key, of(key.name, "repeats")) for key in keys]
    for link in links:
        rows.append(("V6", link.child, link.key, of(link.name, "orphans")))
        if link.attribute:
            verdict = F.when(of(link.parent, "repeats") == 0, of(link.name, "mismatches"))
            rule = ATTRIBUTE_RULES[link.name]
            rows.append((rule, link.child, link.attribute, verdict))
    listed = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(dataset).alias("dataset"),
                F.lit(column).alias("column"),
                value.alias("violations"),
            )
            for rule, dataset, column, value in rows
        ]
    )
    return (
        counts.agg(number.alias("counts"))
        .select(F.inline(listed))
        .where(F.col("violations").isNotNull())
    )


def rule_counts(
    tables: Tables,
    reference_date: date = model.REFERENCE_DATE,
    problems: dict[str, str] | None = None,
) -> DataFrame:
    """Every applicable rule with its violation count.

    When a table cannot be read or lacks a required column, only the schema
    and completeness rules of the usable tables run. Malformed rows (V1) of a
    readable table are counted and left out of all other rules.
    """
    problems = problems or {}
    spark = next(iter(tables.values())).sparkSession if tables else None
    if spark is None:
        raise ValueError("no dataset could be read")
    broken = {
        name
        for name, df in tables.items()
        if missing_columns(df, model.REQUIRED_COLUMNS[name])
    }
    complete = not broken and not problems and set(tables) == set(model.PRIMARY_KEYS)
    usable = {name: df for name, df in tables.items() if name not in broken}
    parts = [_schema_rules(spark, tables, problems)]
    if usable:
        rules = {
            name: _completeness(name, df)
            + (_contents(name, df, reference_date) if complete else [])
            for name, df in usable.items()
        }
        counted = _counted_rules(usable, rules, complete)
        parts.append(counted.withColumn("detail", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, parts)


def violations(
    tables: Tables,
    reference_date: date = model.REFERENCE_DATE,
    problems: dict[str, str] | None = None,
) -> DataFrame:
    return rule_counts(tables, reference_date, problems).where(
        F.col("violations") > 0
    )


def card_preconditions(
    customers: DataFrame,
    cards: DataFrame,
    reference_date: date = model.REFERENCE_DATE,
) -> DataFrame:
    """What must hold before transactions are generated from cards (rule V17)."""
    issue = values.day_or_null(F.col("issue_date"))
    expiry = values.day_or_null(F.col("expiry_date"))
    reference = F.lit(reference_date)
    null_ids = customers.agg(
        F.count_if(F.col("customer_id").isNull()).alias("violations")
    )
    card_rules = cards.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("no_cards"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer"),
        F.count_if(issue.isNull()).alias("null_issue"),
        F.count_if(expiry.isNull()).alias("null_expiry"),
        F.count_if(issue >= expiry).alias("issue_not_before_expiry"),
        F.count_if(issue > reference).alias("issue_in_future"),
        F.count_if(expiry <= reference).alias("expiry_not_after_reference"),
    )
    names = card_rules.columns
    card_rows = card_rules.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"), F.col(name).alias("violations")
                    )
                    for name in names
                ]
            )
        )
    )

    keys = [
        Link("duplicate_customer_id", "customers", "customer_id"),
        Link("duplicate_card_id", "cards", "card_id"),
    ]
    repeats = key_counts({"customers": customers, "cards": cards}, keys).select(
        F.col("link").alias("check"), F.col("repeats").alias("violations")
    )
    nulls = null_ids.select(F.lit("null_customer_id").alias("check"), "violations")
    return nulls.unionByName(repeats).unionByName(card_rows)


SQL_CHECKS = {
    "transaction_card": ("invalid_transaction_card_links", "orphans"),
    "transaction_customer": ("invalid_transaction_customer_links", "orphans"),
    "transaction_merchant": ("invalid_transaction_merchant_links", "orphans"),
}


def sql_checks(tables: Tables) -> DataFrame:
    """The database-side checks: orphans of the fact, owner mismatches."""
    links = [link for link in LINKS if link.name in SQL_CHECKS]
    counts = key_counts(tables, links)
    rows = [
        (check, F.max(F.when(F.col("link") == link, F.col(name))))
        for link, (check, name) in SQL_CHECKS.items()
    ]
    owner = F.max(
        F.when(F.col("link") == "transaction_card", F.col("differing_pairs"))
    )
    rows.append(("transaction_card_customer_mismatches", owner))
    listed = F.array(
        *[
            F.struct(F.lit(check).alias("check"), value.alias("violations"))
            for check, value in rows
        ]
    )
    return counts.agg(listed.alias("checks")).select(F.inline("checks"))


def sensitive_columns(tables: Tables) -> DataFrame:
    """How many published columns carry a forbidden name."""
    spark = next(iter(tables.values())).sparkSession
    found = sum(
        column.lower() in model.CARD_SECRETS
        for df in tables.values()
        for column in df.columns
    )
    return spark.createDataFrame(
        [(found,)], "transactions_with_sensitive_columns long"
    )


def knowledge_base_violations(articles: DataFrame) -> DataFrame:
    """Shape checks of a keyword table (rule V19); an empty table is a violation."""
    counted = articles.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("no_articles"),
        F.count_if(F.col("topic").isNull()).alias("topic"),
        F.count_if(F.col("answer").isNull()).alias("answer"),
        F.count_if(F.col("keywords").isNull()).alias("keywords"),
    )
    names = counted.columns
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"), F.col(name).alias("violations")
                    )
                    for name in names
                ]
            )
        )
    )
