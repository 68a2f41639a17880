"""Exact top-k inner products of quantised vectors by MaxScore.

Dimensions are the terms of a query. Per shard of candidates, the highest product a term
can give bounds it; terms are ordered by bound, and as soon as the bounds of the last
ones together cannot reach the k-th best score so far, these are non-essential: the
postings of the essential terms are traversed, and only candidates that are still
competitive are probed in the others, dropping out as soon as they no longer are. The
best k of every shard are then merged.

Queries and candidates meet in cells of a grid (query block x shard), grouped by both
keys, so no side is broadcast and no cell grows with the data.

Cases: rows whose id is null, or whose vector is null or has a null or non-finite
component, take no part; rows with one id are candidates and queries each for itself, also
for one another; a shorter vector counts as filled up with zeros; equal scores are ordered by id, then by row; fewer than
k other rows give fewer hits; no queries or no rows give an empty result; other columns
are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrain.llm.store import saved

SHARD_ROWS = 8192
QUERY_ROWS = 4096
# Candidates scored in full first, to have a score to compare with.
FIRST = 256
FOUND = ("query_id", "query_row", "vec_id", "row", "score")


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, vec): floor(scale * component) of every usable vector, written."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    vec = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return saved(
        rows.where(usable).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("vec_id"),
            vec.alias("vec"),
        ),
        "vectors",
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each query row.

    ``vectors`` as ``quantised`` gives them: its row numbers tell rows of one id apart.
    """
    counts = vectors.agg(
        F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("queries")
    ).first()
    shards = max(1, ceil(counts.rows / SHARD_ROWS))
    blocks = max(1, ceil(counts.queries / QUERY_ROWS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    queries = (
        vectors.where(is_query)
        .withColumn("block", block)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    candidates = vectors.withColumn("shard", shard).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = search(*_matrix(left), *_matrix(right), k)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(FOUND, columns, strict=True)})

    keys = ["shard", "block"]
    schema = ", ".join(f"{name} long" for name in FOUND)
    hits = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, schema)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, rows and vectors, filled up with zeros to equal length."""
    ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
    lists = table["vec"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    values = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    values[np.arange(values.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    order = np.lexsort((rows, ids))
    return ids[order], rows[order], values[order]


def search(query_ids, query_rows, queries, ids, rows, vectors, k: int):
    """The k best candidates of one shard for each query, as FOUND's columns.

    Candidates are in the order of (id, row), so ties go to the smaller position.
    """
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, vectors))
    if not len(ids) or not len(query_ids):
        return [[] for _ in FOUND]
    columns = np.ascontiguousarray(vectors.T)
    postings = [_posting(column) for column in columns]
    high, low = vectors.max(axis=0, initial=0), vectors.min(axis=0, initial=0)
    place = np.argsort(rows)
    found: list[tuple] = []
    for query_id, query_row, query in zip(query_ids, query_rows, queries, strict=True):
        at = np.searchsorted(rows, query_row, sorter=place)
        own = int(place[at]) if at < len(rows) and rows[place[at]] == query_row else -1
        best, scores = _query(query, own, columns, postings, high, low, k)
        given = np.full(len(best), query_id), np.full(len(best), query_row)
        found.append((*given, ids[best], rows[best], scores))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _posting(column: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Rows that have the term, and their values; None for all rows."""
    rows = np.flatnonzero(column)
    return (None, column) if len(rows) == len(column) else (rows, column[rows])


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller row."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rows[near], -scores[near]))][:k]


def _query(query, own, columns, postings, high, low, k):
    """Positions and scores of the k best candidates for one query, its own left out."""
    size = columns.shape[1]
    bounds = np.maximum(query * high, query * low)  # high >= 0 >= low: none is negative
    terms = np.flatnonzero(query)
    terms = terms[np.argsort(-bounds[terms], kind="stable")]
    rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)

    first = np.arange(min(FIRST, size))
    first = first[first != own]
    sample = query[terms] @ columns[terms][:, first] if len(terms) else np.zeros(len(first), np.int64)
    bar = np.sort(sample)[-k] if len(first) >= k else None

    # Essential terms: without them a candidate stays below the bar.
    essential = len(terms) if bar is None else int(np.searchsorted(-rest, -bar, side="right"))
    essential = min(essential, len(terms))
    scores = np.zeros(size, np.int64)
    for term in terms[:essential]:
        rows, values = postings[term]
        if rows is None:
            scores += query[term] * values
        else:
            scores[rows] += query[term] * values
    if bar is None:
        alive = np.arange(size)
    else:
        alive = np.flatnonzero(scores + rest[essential] >= bar)
    alive = alive[alive != own]
    partial = scores[alive]
    for j in range(essential, len(terms)):
        partial = partial + query[terms[j]] * columns[terms[j], alive]
        if bar is not None:
            still = partial + rest[j + 1] >= bar
            alive, partial = alive[still], partial[still]
    top = _best(partial, alive, k)
    return alive[top], partial[top]
