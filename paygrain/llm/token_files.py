"""Token ids as chunk files of compressed planes, with an index.

Documents are dealt out by ranges of doc_id, encoded, and packed into chunks of whole
documents. A chunk's ids are cut into blocks of BLOCK ids; each block is transposed into
byte planes (or bit planes), so that the rarely changing high planes lie together, and
every plane is compressed with zstandard; planes of zeros above the highest used one are
left out. The files are Parquet containers written by Spark's own committer, so a lost
executor or a repeated task leaves no partial chunk behind, and any store that Spark
reaches will do. The index says, for every chunk, its documents, ids, place in the
stream of all ids, and bytes.

Cases: a null text counts as empty and has the end id only; a null doc_id comes first;
rows with one doc_id are ordered by a hash of their text, then by the text; the content
of an added token in a text becomes that token, as in the library; an empty
table gives files without chunks; a document longer than CHUNK_IDS is a chunk of its own
with as many blocks as it needs; other columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paygrain.llm.byte_units import once

END_ID = 1
BLOCK = 1 << 16
CHUNK_IDS = 1 << 20
CACHE_ENTRIES = 400_000
LEVEL = 3

CHUNK_SCHEMA = (
    "part int, chunk int, start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
    "blocks array<struct<n: int, planes: array<binary>>>"
)
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"

# The pieces between which the tokenizer's own split never merges, and the
# characters that Python takes for white space but the tokenizer does not.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD_SPACES = re.compile("[\x1c-\x1f]")


# --- planes -----------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of a block, lowest first; planes above the highest id are left out."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    used = (int(ids.max()).bit_length() if len(ids) else 0)
    planes = [np.ascontiguousarray(octets[:, k]) for k in range((used + 7) // 8)]
    if not bits:
        return [plane.tobytes() for plane in planes]
    split = [np.unpackbits(plane[:, None], axis=1, bitorder="little") for plane in planes]
    return [np.packbits(part[:, k]).tobytes() for part in split for k in range(8)][:used]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    if bits:
        ids = np.zeros(n, np.uint32)
        for k, plane in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << k
        return ids
    octets = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        octets[:, k] = np.frombuffer(plane, np.uint8)
    return octets.view("<u4").reshape(-1)


# --- encoding ---------------------------------------------------------------------


class _Words(dict):
    """Ids (little-endian bytes) of space-separated words, made when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = self.encode(word)
        return value


def text_encoder(tokenizer_json: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, for a tokenizer that drops white space.

    Words are encoded on their own and remembered. Texts for which this could differ
    from encoding the whole (not in composed form, with letters whose lower case depends
    on the place, or with the content of an added token, which the library finds in a
    text) go through the library whole.
    """
    import regex

    def make():
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        added = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
        pieces = regex.compile(PIECES)

        def library(text: str) -> bytes:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, "<u4").tobytes()

        merge, written = tokenizer.model.tokenize, byte_letters()

        def piece(text: str) -> bytes:
            """Ids of one piece: the model alone, without the library's steps around it."""
            shown = "".join([written[b] for b in text.encode()])
            return np.asarray([token.id for token in merge(shown)], "<u4").tobytes()

        piece_ids = _Words(piece)

        def word(text: str) -> bytes:
            return b"".join(map(piece_ids.__getitem__, pieces.findall(text)))

        words = _Words(word)

        def encode(text: str) -> bytes:
            plain = text.isascii() or (
                "Σ" not in text and unicodedata.is_normalized("NFC", text)
            )
            low = text.lower()
            if not plain or ODD_SPACES.search(text) or any(token in low for token in added):
                return library(text)
            return b"".join(map(words.__getitem__, low.split()))

        return encode

    return once(("words", hash(tokenizer_json)), make)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible characters of Latin-1 stand for themselves, the other bytes for the letters
    from 256 on, in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in visible)
    letters = {b: chr(256 + k) for k, b in enumerate(others)} | {b: chr(b) for b in visible}
    return [letters[b] for b in range(256)]


# --- writing and reading ----------------------------------------------------------


def write_chunks(docs: DataFrame, tokenizer_json: str, path: str, bits: bool = False) -> None:
    """Encode whole texts and write the chunk files below ``path``/chunks, then the index."""
    end = np.asarray([END_ID], "<u4").tobytes()
    row_schema = _arrow(CHUNK_SCHEMA)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode = text_encoder(tokenizer_json)
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        part = TaskContext.get().partitionId()
        chunk, start, doc_ids, texts, held = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            blocks = [
                {"n": len(block), "planes": [compress(p) for p in to_planes(block, bits)]}
                for block in (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK))
            ]
            row = {
                "part": part, "chunk": chunk, "start": start, "n_ids": len(ids), "doc_ids": doc_ids,
                "lengths": [len(t) // 4 for t in texts], "blocks": blocks,
            }
            return pa.RecordBatch.from_pylist([row], schema=row_schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                if texts and held + len(ids) // 4 > CHUNK_IDS:
                    yield flush()
                    chunk, start, doc_ids, texts, held = chunk + 1, start + held, [], [], 0
                doc_ids.append(doc_id.as_py())
                texts.append(ids)
                held += len(ids) // 4
        if texts:
            yield flush()

    order = ["doc_id", F.xxhash64("text"), "text"]
    placed = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"))
    chunks = placed.sortWithinPartitions(*order).mapInArrow(pack, CHUNK_SCHEMA)
    # Planes are compressed already.
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    write_index(docs.sparkSession, path)


def write_index(spark: SparkSession, path: str) -> None:
    """One row per chunk: documents, ids, place in the stream of all ids, bytes.

    Only the narrow columns of the chunks are read. The window without partitions runs
    over one row per file, not per chunk.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    sizes = F.aggregate(
        F.flatten(F.transform("blocks", lambda b: F.transform(b["planes"], F.octet_length))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    rows = chunks.select(
        "part", "chunk", "start", "n_ids",
        F.size("doc_ids").alias("n_docs"), F.element_at("doc_ids", 1).alias("first_doc"),
        F.element_at("doc_ids", -1).alias("last_doc"), sizes.alias("n_bytes"),
    )
    files = chunks.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    (
        rows.join(starts, "part")
        .withColumn("start", F.col("start") + F.col("_before"))
        .drop("_before")
        .write.option("compression", "zstd")
        .parquet(f"{path}/index")
    )


def read_documents(spark: SparkSession, path: str, bits: bool = False) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = chunk_ids(row["blocks"], bits)
                lengths = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(ends - lengths + row["at"]),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").drop("start")
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", F.col("start").alias("at"))
    # Chunks are dealt to tasks by rows of a megabyte or so; the index rows come to them.
    placed = chunks.join(index, ["part", "chunk"]).select("doc_ids", "lengths", "blocks", "at")
    return placed.mapInArrow(unpack, READ_SCHEMA)


def chunk_ids(blocks: list[dict], bits: bool = False) -> np.ndarray:
    """All ids of a chunk's blocks."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    parts = [from_planes([expand(p) for p in b["planes"]], b["n"], bits) for b in blocks]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
