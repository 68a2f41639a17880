"""The registered queries of the subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrain.llm import (
    byte_bpe,
    chat_tree,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    merkle,
    mixing,
    secret_scan,
    spelling,
    statements,
    token_counts,
    token_files,
    topk_search,
)
from paygrain.llm.store import folder

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = "</s>[INST] ok [/INST]"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~held_out))
    return language_id.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted"
    )


def top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk_search.quantised(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def token_planes(spark: SparkSession, sf: str) -> DataFrame:
    from uuid import uuid4

    path = f"{folder(spark)}/paygrain/token-files-{uuid4().hex}"
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        token_files.write_chunks(documents(spark, sf), file.read(), path)
    return token_files.read_documents(spark, path)


def secrets(spark: SparkSession, sf: str) -> DataFrame:
    rows = secret_scan.secret_spans(documents(spark, sf))
    base, every = F.col("spans"), F.col("all_spans")
    counts = [
        secret_scan.count_kind(every, kind).alias(f"n_{kind}") for kind in secret_scan.KINDS
    ]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
        secret_scan.as_text(every).alias("spans"),
    )


def chat(spark: SparkSession, sf: str) -> DataFrame:
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    return chat_tree.read_back(chat_tree.formatted(given.unionByName(hostile)))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    lengths = token_counts.document_lengths(documents(spark, sf), RANKS, public_tokenizers.PATTERN)
    return token_counts.limits(token_counts.histogram(lengths))


def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.linked_documents(documents(spark, sf), 4, 85)


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.replicated(documents(spark, sf))


def byte_pairs(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return byte_bpe.Codec(docs, RANKS, public_tokenizers.PATTERN).round_trip(docs)


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf))


def contaminated(spark: SparkSession, sf: str) -> DataFrame:
    blocks = decontaminate.automata(spark.read.parquet(f"{sf}/benchmark.parquet"))
    rows = decontaminate.matched(documents(spark, sf).select("doc_id", "text"), blocks)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    tampered = merkle.without_line_breaks(F.col("text"), F.col("doc_id"))
    return merkle.manifest(documents(spark, sf), tampered).drop("path")


def spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(documents(spark, sf))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {
    "op1_language_id": language,
    "op2_topk_search": top_k,
    "op3_token_files": token_planes,
    "op4_secret_scan": secrets,
    "op5_chat_tree": chat,
    "op6_token_counts": counts,
    "op7_jaccard_join": jaccard,
    "op8_mixing": mixed,
    "op9_byte_bpe": byte_pairs,
    "op10_exact_dedup": duplicates,
    "op11_decontamination": contaminated,
    "op12_merkle_manifest": merkle_manifest,
    "op13_spelling_variants": spelling_variants,
    "pipeline": pipeline,
}

_TOP_K = """
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, c.row,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.vec, c.vec)])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.row <> c.row
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row)::INTEGER AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# The probabilities of each source are summed in the same order as in the query.
_MIXING = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source
), sums AS (
  SELECT sum(weight) AS weights, sum(n)::DOUBLE AS docs FROM sizes
), rates AS (
  SELECT source, docs * (weight / weights) / n AS rate FROM sizes, sums
), draws AS (
  SELECT source, greatest(ceil(rate / {mixing.DRAW_RATE}), 1)::BIGINT AS draws, rate FROM rates
), terms AS (
  SELECT source, draws, rate / draws AS mean, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c
  FROM draws
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
  FROM terms WHERE k < {mixing.TERMS}
), hashed AS (
  SELECT doc_id, text, lang, source, n_chars, md5({" || ".join(map(statements.field, _COLUMNS))}) AS hash,
         row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) AS number
  FROM documents
), drawn AS (
  SELECT d.*, u.j,
         ('0x' || substr(md5('0:' || hash || ':' || number || ':' || u.j), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT hashed.*, draws FROM hashed JOIN draws
        ON hashed.source IS NOT DISTINCT FROM draws.source) d, unnest(range(1, draws + 1)) AS u(j)
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.hash, d.number, count(t.k) AS copies
  FROM drawn d JOIN terms t ON t.source IS NOT DISTINCT FROM d.source AND t.c <= d.u
  GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, c.copy AS copy, copies,
       md5('0:shuffle:' || hash || ':' || number || ':' || c.copy) AS mix_key
FROM counted, unnest(range(1, copies + 1)) AS c(copy)
"""

_DUPLICATES = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept,
       text_sha256
FROM keyed
WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""

ORACLES: dict[str, str] = {
    "op2_topk_search": _TOP_K,
    "op8_mixing": _MIXING,
    "op10_exact_dedup": _DUPLICATES,
    "op11_decontamination": statements.DECONTAMINATION,
    "op12_merkle_manifest": statements.MERKLE,
    "op13_spelling_variants": statements.SPELLING,
}
