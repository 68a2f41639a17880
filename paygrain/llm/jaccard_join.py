"""Similarity join of documents on word n-grams with adaptive multi-match prefixes.

A document is its set of n-word shingles; two link when their Jaccard similarity reaches
a threshold. Shingles are ordered from rare to frequent over the corpus. If two sets
share at least a of their elements, their prefixes of size |x| - a + l share at least l:
each document picks the l (and so the prefix) that is estimated to cost least, and a pair
is verified only if it shares as many prefix shingles as the lower of the two l asks for.

How it runs:

1. Shingles are hashed where the texts are, packed by blocks of documents, and dealt to
   buckets by hash. A bucket counts in how many documents each shingle occurs and returns
   the repeated ones only, each block's to the block. Shingles travel sorted, as differences,
   with the number of their document in the block. A document without enough repeated
   shingles links with nothing and drops out here; unique shingles never travel again.
2. Equal sets become one class. Classes that share a prefix shingle are dealt to blocks of
   limited size by their smallest shingle hash, so that copies meet. Within a block, stars
   around members are verified until every link is used: its clusters are exact.
3. Prefix shingles are collapsed to blocks, and blocks that share enough of them are
   verified against each other, cluster by cluster up to the first link. The larger block
   of a pair stays and the smaller ones come to it; no pair of documents is ever a row,
   also in a group of very many copies. Nothing that could link two blocks is left out.
4. Components of the links between clusters follow by least labels, with checkpoints.

Cases: words are separated by ASCII white space and compared with A-Z lower-cased; fewer
words than n are one shingle; a null or wordless text has no shingles and links with
nothing; repeated rows and ties link; a null doc_id never names a component that has
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.llm.store import saved, small_batches

# Characters of text per bucket and per block: bounds the memory of a task.
PART_CHARS = 4_000_000
# Shingles and documents of a block of documents; a document's number has two bytes.
FLUSH_TOKENS = 1 << 18
FLUSH_DOCS = 1 << 15
# A shingle that so many documents of a block have is counted within the block first.
COMMON = 16
HASH_BYTES = 1 << 19
LONGEST_PREFIX = 16
VERIFY_COST = 20
# A block's classes and shingles.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 1 << 21
BROADCAST_KEYS = 100_000

PACKED = "bucket long, block long, info boolean, payload binary"
FOUND = "doc_id long, row binary, n_shingles long, digest binary, tokens binary, counts binary"
ROW_BYTES = 16


# --- shingles ---------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_VALUES[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < size:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(size, 2 * HASH_BYTES), np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:size], _powers["down"][:size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in a run of bytes."""
    solid = ~_SPACE[data]
    edges = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts]), starts


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    count = len(words) - width + 1
    h = np.full(count, np.uint64(width))
    for k in range(width):
        h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + count])
    return h


def _text_blocks(texts: list[bytes], size: int = HASH_BYTES) -> Iterator[list[int]]:
    """Numbers of consecutive texts that together have about ``size`` bytes."""
    held, block = 0, []
    for i, text in enumerate(texts):
        if block and held + len(text) > size:
            yield block
            held, block = 0, []
        block.append(i)
        held += len(text)
    if block:
        yield block


def _long_words(text: bytes, size: int = HASH_BYTES) -> np.ndarray:
    """Word hashes of one long text, cut at white space into blocks."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        parts.append(word_hashes(np.frombuffer(text, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    found = []
    for block in _text_blocks(texts):
        if len(block) == 1:
            words, bounds = _long_words(texts[block[0]]), None
            cuts = [(0, len(words))]
        else:
            joined = b" ".join(texts[i] for i in block)
            words, starts = word_hashes(np.frombuffer(joined, np.uint8))
            lengths = np.array([len(texts[i]) + 1 for i in block])
            bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
            cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
        runs = _fold(words, n) if len(words) >= n else None
        for first, last in cuts:
            if last - first >= n:
                found.append(np.unique(runs[first : last - n + 1]))
            elif last > first:
                found.append(_fold(words[first:last], last - first))
            else:
                found.append(np.zeros(0, np.uint64))
    return found


# --- packing ----------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each led by its length in bytes."""
    parts = []
    for array in arrays:
        data = array.tobytes()
        parts += [len(data).to_bytes(8, "little"), data]
    return b"".join(parts)


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    arrays, at = [], 0
    for kind in kinds:
        size = int.from_bytes(payload[at : at + 8], "little")
        arrays.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return arrays


def _steps(ascending: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending numbers as differences, in planes of their lower and higher bytes.

    Higher planes of small differences are zeros, which the shuffle's compression takes out.
    """
    steps = np.diff(ascending, prepend=ascending.dtype.type(0)).astype(np.uint64)
    return steps.astype("<u4"), (steps >> np.uint64(32)).astype("<u2"), (steps >> np.uint64(48)).astype("<u2")


def _climbed(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    steps = low.astype(np.uint64) | (middle.astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(48))
    return np.cumsum(steps, dtype=np.uint64)


def _halves(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return numbers.astype("<u2"), (numbers >> 16).astype("<u2")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | (high.astype(np.int64) << 16)


# --- step 1: repeated shingles ----------------------------------------------------


def repeated_shingles(docs: DataFrame, n: int, share: int, row: str | None = None) -> DataFrame:
    """One row per document; tokens (rare ones first) and counts where it may link.

    ``share`` is the threshold in percent. A document may link if it has at least as many
    repeated shingles as a linked one must share. ``row`` names a column of ROW_BYTES
    bytes that is carried along as ``row``; without one that is null.

    A task that is repeated must get its rows in the same order, as it does from files.
    If it does not, the documents of a block are not found and the job fails.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(max(8, ceil(size / PART_CHARS)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flushes = TaskContext.get().partitionId(), 0
        doc_ids, row_keys, sets, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [(t or "").encode() for t in rows.column(1).to_pylist()]
                doc_ids += rows.column(0).to_pylist()
                row_keys += rows.column(2).to_pylist() if row else [b""] * len(texts)
                sets += shingle_sets(texts, n)
                held += sum(map(len, sets[-len(texts) :]))
                if held >= FLUSH_TOKENS or len(sets) >= FLUSH_DOCS:
                    yield from _scattered((task, flushes), doc_ids, row_keys, sets, parts)
                    doc_ids, row_keys, sets, held = [], [], [], 0
                    flushes += 1
        if doc_ids:
            yield from _scattered((task, flushes), doc_ids, row_keys, sets, parts)

    def gather(rows: pa.Table) -> pa.Table:
        return _gathered(rows, share)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(row).alias("row")] if row else [])]
    packed = docs.select(*columns).mapInArrow(scatter, PACKED)
    returned = packed.groupBy("bucket").applyInArrow(_counted, "block long, info boolean, payload binary")
    return returned.groupBy("block").applyInArrow(gather, FOUND)


def _packed_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "block": pa.int64(), "info": pa.bool_(), "payload": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=True)], names=names
    )


def _scattered(origin, doc_ids, row_keys, sets, parts) -> Iterator[pa.RecordBatch]:
    """A block of documents: one row with what it holds, and a packed row per bucket.

    A shingle that many documents of the block have goes to its bucket once, with their
    number; which documents they are stays with the block. So a bucket gets a bounded
    number of entries per block, however common a shingle is.
    """
    digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    name = blake2b(repr((origin, doc_ids)).encode() + b"".join(digests), digest_size=8).digest()
    block = int.from_bytes(name, "little") >> 1
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(tokens)))
    common = runs >= COMMON
    in_common = np.repeat(common, runs)
    hot, hot_runs = tokens[first[common]], runs[common]

    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    shas, carried = (np.frombuffer(b"".join(values), np.uint8) for values in (digests, row_keys))
    info = _pack(ids, known, sizes, shas, carried, hot_runs.astype("<u4"), owner[in_common])
    names = ["bucket", "block", "info", "payload"]
    rows = [(block % parts, block, True, info)]

    def bucket_of(tokens: np.ndarray) -> np.ndarray:
        return ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)

    single, single_owner = tokens[~in_common], owner[~in_common]
    single_bucket, hot_bucket = bucket_of(single), bucket_of(hot)
    for b in np.unique(np.concatenate([single_bucket, hot_bucket])):
        one = slice(*np.searchsorted(single_bucket, [b, b + np.uint64(1)]))
        many = slice(*np.searchsorted(hot_bucket, [b, b + np.uint64(1)]))
        payload = _pack(
            *_steps(single[one]), single_owner[one],
            hot[many], hot_runs[many].astype("<u4"), np.arange(many.start, many.stop, dtype="<u4"),
        )
        rows.append((int(b), block, False, payload))
        if len(rows) >= 256:
            yield _packed_rows(rows, names)
            rows = []
    if rows:
        yield _packed_rows(rows, names)


def _counted(rows: pa.Table) -> pa.Table:
    """Of one bucket: the shingles that occur in several documents, by block.

    A shingle gets its number among the bucket's repeated ones and its document count.
    """
    names = ["block", "info", "payload"]
    out, blocks, single, owner, hot, hot_runs, hot_at = [], [], [], [], [], [], []
    for block, info, payload in zip(rows["block"], rows["info"], rows["payload"], strict=True):
        data = payload.as_py()
        if info.as_py():
            out.append((block.as_py(), True, data))
            continue
        low, middle, high, own, common, runs, at = _unpack(data, "<u4", "<u2", "<u2", "<u2", "<u8", "<u4", "<u4")
        blocks.append(block.as_py())
        single.append(_climbed(low, middle, high))
        owner.append(own)
        hot.append(common)
        hot_runs.append(runs)
        hot_at.append(at)
    if blocks:
        of_single, of_hot = (np.repeat(np.arange(len(blocks)), [len(x) for x in xs]) for xs in (single, hot))
        single, owner, hot, hot_runs, hot_at = (np.concatenate(x) for x in (single, owner, hot, hot_runs, hot_at))
        distinct, which = np.unique(np.concatenate([single, hot]), return_inverse=True)
        weights = np.concatenate([np.ones(len(single), np.int64), hot_runs.astype(np.int64)])
        counts = np.bincount(which, weights, len(distinct)).astype(np.int64)
        number = np.cumsum(counts > 1) - 1
        which_single, which_hot = which[: len(single)], which[len(single) :]
        often = counts[which_single] > 1
        which_single, owner, of_single = which_single[often], owner[often], of_single[often]
        order = np.lexsort((which_single, of_single))
        which_single, owner, of_single = which_single[order], owner[order], of_single[order]
        edges, hot_edges = (np.searchsorted(of, np.arange(len(blocks) + 1)) for of in (of_single, of_hot))
        bucket = np.array([rows["bucket"][0].as_py()], "<u8")
        for k, block in enumerate(blocks):
            one, many = slice(edges[k], edges[k + 1]), slice(hot_edges[k], hot_edges[k + 1])
            if one.start == one.stop and many.start == many.stop:
                continue
            found, common = which_single[one], which_hot[many]
            payload = _pack(
                bucket, *_halves(np.diff(number[found], prepend=0)), owner[one], *_halves(counts[found]),
                hot_at[many], number[common].astype("<u4"), counts[common].astype("<u4"),
            )
            out.append((block, False, payload))
    return pa.Table.from_batches([_packed_rows(out, names)])


def least_shared(n: int, share: int) -> int:
    """How many of its n shingles a document shares with any that it links with."""
    return -(-share * n // 100)


def _gathered(rows: pa.Table, share: int) -> pa.Table:
    """One row per document of a block."""
    is_info = [value.as_py() for value in rows["info"]]
    if sum(is_info) != 1:
        raise RuntimeError("a repeated task got its rows in another order: write the documents first")
    info = rows["payload"][is_info.index(True)].as_py()
    ids, known, sizes, shas, carried, hot_runs, hot_owner = _unpack(info, "<i8", "u1", "<i8", "u1", "u1", "<u4", "<u2")
    hot_start = np.append(0, np.cumsum(hot_runs.astype(np.int64)))
    owners, tokens, counts = [], [], []
    for about_docs, payload in zip(is_info, rows["payload"], strict=True):
        if about_docs:
            continue
        bucket, step, far, owner, low, high, at, hot_number, hot_count = _unpack(
            payload.as_py(), "<u8", "<u2", "<u2", "<u2", "<u2", "<u2", "<u4", "<u4", "<u4"
        )
        held = [hot_owner[hot_start[i] : hot_start[i + 1]] for i in at]
        spread = np.array([len(x) for x in held], np.int64)
        single = np.cumsum(_joined(step, far))
        number = np.concatenate([single, np.repeat(hot_number, spread)]).astype(np.uint64)
        owners.append(np.concatenate([owner, *held]))
        # One to one: bucket and number name the shingle.
        tokens.append(_mix((bucket[0] << np.uint64(32)) | number))
        counts.append(np.concatenate([_joined(low, high), np.repeat(hot_count, spread).astype(np.int64)]))
    if owners:
        owners, tokens, counts = (np.concatenate(x) for x in (owners, tokens, counts))
        order = np.lexsort((tokens, counts, owners))
        owners, tokens, counts = owners[order], tokens[order], counts[order].astype("<u4")
    else:
        owners, tokens, counts = np.zeros(0, "<u2"), np.zeros(0, np.uint64), np.zeros(0, "<u4")
    edges = np.searchsorted(owners, np.arange(len(ids) + 1))
    out = {name: [] for name in ("doc_id", "row", "n_shingles", "digest", "tokens", "counts")}
    for i, n in enumerate(sizes.tolist()):
        own = slice(edges[i], edges[i + 1])
        may = n > 0 and own.stop - own.start >= least_shared(n, share)
        out["doc_id"].append(int(ids[i]) if known[i] else None)
        out["row"].append(carried[ROW_BYTES * i : ROW_BYTES * (i + 1)].tobytes() or None)
        out["n_shingles"].append(n)
        out["digest"].append(shas[16 * i : 16 * i + 16].tobytes())
        out["tokens"].append(tokens[own].tobytes() if may else None)
        out["counts"].append(counts[own].tobytes() if may else None)
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({name: pa.array(c, k) for (name, c), k in zip(out.items(), kinds, strict=True)})


# --- step 2: prefixes and clusters ------------------------------------------------


def prefix(n: int, counts: np.ndarray, share: int) -> tuple[int, np.ndarray]:
    """The l of least estimated cost, and the level of every shingle of its prefix.

    ``counts`` are of the repeated shingles, rare first; the n - len(counts) others come
    before them and match nothing. A shingle of level k is in the prefixes for l >= k. The
    estimate: reading the postings, and verifying at most 1/l as many documents.
    """
    unique, least = n - len(counts), least_shared(n, share)
    base = n - least + 1
    most = max(1, min(LONGEST_PREFIX, least))
    sizes = np.clip(base + np.arange(most) - unique, 0, len(counts))
    read = np.append(0, np.cumsum(counts.astype(np.float64) - 1))[sizes]
    wanted = int(np.argmin(read * (1 + VERIFY_COST / np.arange(1, most + 1)))) + 1
    places = unique + np.arange(int(sizes[wanted - 1]))
    return wanted, np.maximum(1, places - base + 2)


def _postings(classes: DataFrame, share: int) -> DataFrame:
    """(token, class, level, wanted) for the prefix of every class."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cls, n, tokens, counts = (batch.column(c)[i].as_py() for c in range(4))
                counts = np.frombuffer(counts, "<u4")
                wanted, levels = prefix(n, counts, share)
                size = len(levels)
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.frombuffer(tokens, "<i8")[:size]),
                            pa.array([cls] * size, pa.binary()),
                            pa.array(levels.astype(np.int32)),
                            pa.array(np.full(size, wanted, np.int32)),
                        ],
                        ["token", "cls", "level", "wanted"],
                    )

    return classes.select("cls", "n_shingles", "tokens", "counts").mapInArrow(
        emit, "token long, cls binary, level int, wanted int"
    )


def linked(n_a, n_b, both, share: int):
    """Whether sets of these sizes with this overlap are similar enough."""
    return 100 * both >= share * (n_a + n_b - both)


def overlaps(one: np.ndarray, joined: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many elements a sorted set shares with each of several, joined ones."""
    at = np.searchsorted(one, joined)
    at[at == len(one)] = 0
    hits = np.append(0, np.cumsum(one[at] == joined))
    ends = np.cumsum(sizes)
    return hits[ends] - hits[ends - sizes]


def cluster(sets: list[np.ndarray], n: np.ndarray, share: int) -> np.ndarray:
    """Component of every set, from all links between them.

    Stars: a member is compared with all others, which joins those it links with. Members
    of the largest component need no star: each pair is then either inside it, or had one
    end compared.
    """
    labels = np.arange(len(sets))
    joined, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    done = np.zeros(len(sets), bool)
    while True:
        names, counts = np.unique(labels, return_counts=True)
        largest = names[np.argmax(counts)]
        open_ = np.flatnonzero(~done & (labels != largest)) if counts.max() > 1 else np.flatnonzero(~done)
        if not len(open_):
            return labels
        star = open_[0]
        done[star] = True
        both = overlaps(np.sort(sets[star]), joined, sizes)
        near = np.flatnonzero(linked(n[star], n, both, share))
        touched = np.unique(np.append(labels[near], labels[star]))
        labels[np.isin(labels, touched)] = touched.min()


def _clusters(active: DataFrame, share: int) -> DataFrame:
    """(cls, cluster) for the active classes, clustered in blocks of limited size."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cls, n, tokens = (batch.column(c)[i].as_py() for c in range(3))
                least = int(_mix(np.frombuffer(tokens, "<u8")).min() >> np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cls], pa.binary()), pa.array([n], pa.int64()), pa.array([tokens], pa.binary()), pa.array([least], pa.int64())],
                    ["cls", "n_shingles", "tokens", "least"],
                )

    keyed = active.select("cls", "n_shingles", "tokens").mapInArrow(
        smallest, "cls binary, n_shingles long, tokens binary, least long"
    )
    parts = F.greatest(
        F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
    )
    sizes = saved(keyed.groupBy("least").agg(parts.alias("parts")).where("parts > 1"), "join-sizes")
    few = sizes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    part = F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1).cast("long")))
    dealt = keyed.join(F.broadcast(sizes) if few else sizes, "least", "left").withColumn(
        "block", F.concat_ws(":", "least", part)
    )

    def label(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.array(rows["cls"].to_pylist(), object), kind="stable")
        names = [rows["cls"][int(i)].as_py() for i in order]
        sets = [np.frombuffer(rows["tokens"][int(i)].as_py(), "<u8") for i in order]
        labels = cluster(sets, rows["n_shingles"].to_numpy()[order], share)
        return pa.table(
            {
                "cls": pa.array(names, pa.binary()),
                "cluster": pa.array([names[k] for k in labels], pa.binary()),
                "block": pa.array([rows["block"][0].as_py()] * len(names)),
            }
        )

    return dealt.select("block", "cls", "n_shingles", "tokens").groupBy("block").applyInArrow(
        label, "cls binary, cluster binary, block string"
    )


# --- step 3: links between blocks -------------------------------------------------


def _block_pairs(postings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): blocks that share as many prefix shingles as the lower l asks for.

    A block has the shingles of all its members, each at its lowest level, and the lowest
    l: what any pair of members shares, the blocks share.
    """
    named = postings.join(clusters, "cls")
    wanted = named.groupBy("block").agg(F.min("wanted").alias("wanted"))
    held = named.groupBy("token", "block").agg(F.min("level").alias("level"))
    several = held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    sides = saved(held.join(several, "token").join(wanted, "block"), "join-postings")
    a, b = sides.alias("a"), sides.alias("b")
    asked = F.least("a.wanted", "b.wanted")
    met = (F.col("a.level") <= asked) & (F.col("b.level") <= asked)
    return (
        a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.block") < F.col("b.block")) & met)
        .groupBy(F.col("a.block").alias("a"), F.col("b.block").alias("b"))
        .agg(F.count("*").alias("shared"), F.min(asked).alias("asked"))
        .where("shared >= asked")
        .select("a", "b")
    )


def _verified(pairs: DataFrame, active: DataFrame, clusters: DataFrame, share: int) -> DataFrame:
    """(a, b): linked clusters of the paired blocks.

    The larger block of a pair is the host; its smaller partners are dealt to it in
    portions of limited size.
    """
    members = saved(
        active.select("cls", "n_shingles", "tokens").join(clusters, "cls").drop("cls"), "join-members"
    )
    weights = members.groupBy("block").agg(F.sum("n_shingles").alias("weight"))
    weighed = pairs.join(
        weights.select(F.col("block").alias("a"), F.col("weight").alias("weight_a")), "a"
    ).join(weights.select(F.col("block").alias("b"), F.col("weight").alias("weight_b")), "b")
    first = F.col("weight_a") >= F.col("weight_b")
    turned = saved(
        weighed.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"),
            F.least("weight_a", "weight_b").alias("weight"),
        ),
        "join-pairs",
    )
    portions = turned.groupBy("host").agg(F.ceil(F.sum("weight") / BLOCK_SHINGLES).alias("portions"))
    met = turned.join(portions, "host").select(
        "host", "guest", F.pmod(F.xxhash64("guest"), "portions").alias("portion")
    )
    hosts = met.select("host", "portion").distinct().join(members.withColumnRenamed("block", "host"), "host")
    guests = met.join(members.withColumnRenamed("block", "guest"), "guest").select(
        *[F.col(name).alias(f"guest_{name}") for name in ("host", "portion", "cluster", "n_shingles", "tokens")]
    )

    def check(host: pa.Table, guest: pa.Table) -> pa.Table:
        hits = _links_between(_members(host, ""), _members(guest, "guest_"), share)
        return pa.table({"a": pa.array([h[0] for h in hits], pa.binary()), "b": pa.array([h[1] for h in hits], pa.binary())})

    left = hosts.groupBy("host", "portion")
    right = guests.groupBy("guest_host", "guest_portion")
    return left.cogroup(right).applyInArrow(check, "a binary, b binary")


def _members(rows: pa.Table, side: str) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """Members' clusters, shingle counts and repeated shingles, sorted."""
    sets = [np.sort(np.frombuffer(t.as_py(), "<u8")) for t in rows[f"{side}tokens"]]
    return rows[f"{side}cluster"].to_pylist(), rows[f"{side}n_shingles"].to_numpy(), sets


def _links_between(host, guest, share: int) -> list[tuple[bytes, bytes]]:
    """Linked clusters, each pair once; linked ones are not compared again."""
    names, n, sets = host
    sizes = np.array([len(s) for s in sets])
    codes = {name: k for k, name in enumerate(dict.fromkeys(names))}
    cluster_of = np.array([codes[name] for name in names])
    order = np.argsort(cluster_of, kind="stable")
    joined = np.concatenate([sets[i] for i in order])
    sizes, n, cluster_of = sizes[order], n[order], cluster_of[order]
    labels = list(codes)
    found: dict[bytes, set[int]] = {}
    for name, size, one in zip(*guest, strict=True):
        known = found.setdefault(name, set())
        if len(known) == len(labels):
            continue
        near = linked(n, size, overlaps(one, joined, sizes), share)
        known.update(np.unique(cluster_of[near]).tolist())
    return [(labels[k], name) for name, known in found.items() for k in known]


# --- step 4: components -----------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links lead to, for nodes with links.

    Labels move to neighbours and then to their label's label, so the rounds grow with
    the logarithm of the longest chain. Every round is a written table.
    """
    both = saved(
        links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("to"))
        ),
        "join-links",
    )
    labels = saved(
        both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "join-labels"
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("node", "to"), "to")
            .groupBy("node")
            .agg(F.min("label").alias("heard"))
        )
        spread = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = saved(
            spread.join(jump, "next", "left").select(
                "node", "old", F.least("next", F.coalesce("far", "next")).alias("label")
            ),
            "join-labels",
        )
        labels = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            return labels


def linked_documents(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when ``100 * intersection >= share * union`` of their sets of n-word
    shingles; component_id is the smallest doc_id that links lead to.
    """
    rows, several = _components_of(docs, n, share)
    return rows.select("doc_id", "n_shingles", "digest").join(several, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("best.doc_id", "doc_id").alias("component_id")
    )


def _components_of(docs: DataFrame, n: int, share: int, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with their digests, and (digest, best) of components of several rows.

    ``best`` is the component's first row by (doc_id with null last, row).
    """
    rows = saved(repeated_shingles(docs, n, share, row), "join-documents")
    classes = saved(
        rows.where("tokens is not null")
        .groupBy(F.col("digest").alias("cls"))
        .agg(
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("tokens").alias("tokens"),
            F.any_value("counts").alias("counts"),
        ),
        "join-classes",
    )
    postings = _postings(classes, share)
    met = postings.groupBy("token").agg(F.min("cls").alias("one"), F.max("cls").alias("two"))
    shared = postings.join(met.where("one != two").select("token"), "token")
    postings = saved(shared, "join-prefixes")
    active = saved(classes.join(postings.select("cls").distinct(), "cls", "left_semi"), "join-active")
    clusters = saved(_clusters(active, share), "join-clusters")
    pairs = _block_pairs(postings, clusters)
    links = _verified(pairs, active, clusters, share)
    labels = components(links)
    label = F.coalesce("label", "cluster")
    named = clusters.join(labels.withColumnRenamed("node", "cluster"), "cluster", "left").select(
        F.col("cls").alias("digest"), label.alias("label")
    )
    # Per class its first row, then per component; unlinked classes stand alone.
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    sizes = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min(first).alias("best"), F.count("*").alias("size")
    )
    placed = sizes.join(named, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = placed.groupBy("label").agg(
        F.min("best").alias("best"), F.sum("size").alias("members")
    )
    # Written, so that the join below may split a set that very many documents have.
    several = saved(
        placed.drop("best").join(least.where("members > 1"), "label").select("digest", "best"),
        "join-components",
    )
    return rows, several


def _row_key() -> Column:
    """Bytes that are the same for rows of equal doc_id and text only."""
    doc_id = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(doc_id, F.lit(":"), F.coalesce("text", F.lit("")))))


def one_of_each(docs: DataFrame, n: int = 5, share: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """The documents that stay when exactly one row of each component does.

    The smallest doc_id stays (null last), then the least hash of doc_id and text, then
    any one of the rows that have both in common. Rows are told apart by that hash, which
    needs no copy of the table: a row that links with nothing stays whatever its doc_id.
    """
    rows, several = _components_of(docs.select("doc_id", "text", _row_key().alias("_key")), n, share, "_key")
    linked_rows = saved(
        rows.select("row", "digest")
        .join(several, "digest")
        .select(F.col("row").alias("_key"), (F.col("row") == F.col("best.row")).alias("_first"))
        .distinct(),
        "join-rows",
    )
    few = linked_rows.limit(most_broadcast + 1).count() <= most_broadcast
    named = F.broadcast(linked_rows) if few else linked_rows
    keyed = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"), _row_key().alias("_key"))
    alone = keyed.join(named, "_key", "left_anti").select("_row.*")
    # Rows of one key link with the same rows, so they are all first or none is.
    first = keyed.join(named.where("_first"), "_key", "left_semi")
    return alone.unionByName(first.groupBy("_key").agg(F.any_value("_row").alias("_row")).select("_row.*"))
