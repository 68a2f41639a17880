"""Token counts for every context limit from an exact length histogram.

Documents are encoded once and aggregated by encoded length. Running sums over the
histogram (bucketed, so no task holds all of it) then answer, for any context limit:
documents and tokens that fit, documents that do not, the total after truncation, and
the quantile a length stands for.

Cases: a null text counts as empty, with 0 tokens; an empty table gives an empty
histogram; ties and repeated rows count each time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrain.llm.byte_units import read_ranks, token_counter
from paygrain.llm.store import saved

BUCKET = 1024


def document_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: n_tokens. Texts stay where they are read."""
    ranks = read_ranks(ranks_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_counter(ranks, pattern)
        for batch in batches:
            lengths = [tokens(text) if text else 0 for text in _texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Values one by one: a batch's texts are not all held as Python strings."""
    return (value.as_py() for value in column)


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs), one row per occurring length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For every occurring length taken as context limit: what fits and what is cut.

    docs_within and tokens_within cover documents of at most that length, docs_longer
    the suffix; truncated_total is the tokens left when every document is cut to the
    limit; quantile is the share of documents within. Between two occurring lengths
    only truncated_total changes, by docs_longer per token: see ``truncated_total``.
    """
    # Read twice below; written once, so that documents are encoded once.
    hist = saved(hist, "lengths")
    sized = hist.withColumn("_bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn(
        "_tokens", F.col("n_tokens") * F.col("docs")
    )
    buckets = sized.groupBy("_bucket").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    # One row per BUCKET lengths: the only window over a single partition.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = buckets.select(
        "_bucket",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_docs_before"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_tokens_before"),
        F.sum("_d").over(whole).alias("_all"),
    )
    inside = Window.partitionBy("_bucket").orderBy("n_tokens").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        sized.withColumn("_di", F.sum("docs").over(inside))
        .withColumn("_ti", F.sum("_tokens").over(inside))
        .join(starts, "_bucket")
        .select(
            "n_tokens",
            "docs",
            (F.col("_di") + F.col("_docs_before")).alias("docs_within"),
            (F.col("_ti") + F.col("_tokens_before")).alias("tokens_within"),
            (F.col("_all") - F.col("_di") - F.col("_docs_before")).alias("docs_longer"),
            "_all",
        )
        .select(
            "n_tokens",
            "docs",
            "docs_within",
            "tokens_within",
            "docs_longer",
            (F.col("tokens_within") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
            (F.col("docs_within") / F.col("_all")).alias("quantile"),
        )
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: total, truncated_total and docs_longer."""
    length = F.col("n_tokens")
    return hist.agg(
        F.coalesce(F.sum(length * F.col("docs")), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.least(length, F.lit(limit)) * F.col("docs")), F.lit(0)).alias("truncated_total"),
        F.coalesce(F.sum(F.when(length > limit, F.col("docs"))), F.lit(0)).alias("docs_longer"),
    )


def quantiles(limit_rows: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that covers each share of the documents."""
    picks = [
        F.min(F.when(F.col("quantile") >= share, F.col("n_tokens"))).alias(str(i))
        for i, share in enumerate(shares)
    ]
    pairs = F.array(*[
        F.struct(F.lit(float(s)).alias("share"), F.col(str(i)).alias("n_tokens"))
        for i, s in enumerate(shares)
    ])
    return limit_rows.agg(*picks).select(F.inline(pairs))
