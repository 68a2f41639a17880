"""A corpus pipeline of five stages; each is written as Parquet and read by the next.

Language identification drops what it rejects, exact and near duplicates leave one
document of each group, sources are mixed to target weights, and what is left is encoded
by byte-level BPE. Every stage works on all rows its predecessor kept.

Cases, stage by stage: a null or letterless text is in no language and goes; exact copies
leave their longest original, then the smallest doc_id (null last); near copies leave the
smallest doc_id (null last), then the least hash of doc_id and text; every row is drawn
for itself when sources are mixed, whatever its doc_id, and a null source is a source;
texts of any length are encoded whole. Ties and repeated rows are copies. An empty table
passes as one, and columns beyond those used are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paygrain.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from paygrain.llm.store import folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Near duplicates: shingles of this many words, and this similarity in percent.
WORDS, SIMILARITY = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; learned from the labelled ones among them."""
    model = language_id.train(docs)
    return language_id.identified(docs, model).where("accepted").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of all that are equal but for white space; null counts as empty."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies link; wordless texts link with none."""
    return jaccard_join.one_of_each(docs, WORDS, SIMILARITY)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, as many as their source's target weight asks for."""
    return mixing.replicated(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every copy."""
    return byte_bpe.Codec(docs, RANKS, public_tokenizers.PATTERN).round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", encoded),
]

# A trained classifier and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/paygrain/pipeline-{uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
