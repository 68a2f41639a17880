"""Byte-level BPE: Spark's higher-order functions fold ranked merges over words.

Every task splits its documents into words (matches of the split pattern) and numbers
them: a chunk is a run of documents with a numbering of its own, a document a sequence of
numbers. Spark folds the words that are new in each chunk, where they are: a word becomes an
array of bytes, and an aggregate merges the adjacent pair of lowest rank until none has one.
Ranks are one row of a table, dealt into buckets by a hash so that a look-up is not a scan; ranks
of pairs are kept, so that a merge asks for two. The next step of the same task puts the
documents together from the ids, so neither texts nor ids are shuffled.

Words that most chunks have would be folded in each. Those that are frequent in a sample of
the documents are folded by Spark beforehand, once, and go with every task as numbers that all
chunks know. Which words these are changes the work and no result: any other word of any
document is folded in its chunk.

Decoding concatenates the binary pieces of the ids.

Cases: a null text counts as empty and has no ids; repeated rows and null doc_ids are
encoded row by row; a word of any length is encoded whole, one of more than FOLD_BYTES bytes
by the tokenizer library; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrain.llm.byte_units import CACHE_ENTRIES, PartCache, encoding, read_ranks
from paygrain.llm.store import saved, small_batches

RANK_BUCKETS = 1 << 13
# More than any rank.
ID_BITS = 20
IDS = 1 << ID_BITS
# A chunk ends with the document that fills one of these: distinct words, and characters.
CHUNK_WORDS = 1 << 19
CHUNK_CHARS = 1 << 25
# Texts are looked at together up to a chunk's words, squared, by this many characters: their
# distinct words grow far slower than they do.
WORDS_SQUARED = 1 << 18
# A fold's work grows with the square of a length. Words beyond this, of no language's
# writing, go to the tokenizer library where their text is put together.
FOLD_BYTES = 1 << 10
# More than a folded word has places.
PLACES = 2 * FOLD_BYTES
PART_BITS = ID_BITS + PLACES.bit_length() - 1
# Words folded beforehand: at most so many, of so many documents (expected), counted once per
# chunk of these.
FREQUENT_WORDS = 700_000
SAMPLE_DOCS = 1 << 15
SAMPLE_TASKS = 64
# Words that are strings at a time while all are hashed.
HASHED_WORDS = 1 << 15

NUMBERED = "chunk long, doc_id long, low binary, high binary, first int, words array<binary>"
ENCODED = "doc_id long, ids binary"
ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TABLES = pa.struct({
    "shifts": pa.list_(pa.int64()), "table": pa.list_(pa.int64()),
    "tokens": pa.list_(pa.map_(pa.string(), pa.int32())), "octets": pa.list_(pa.int64()),
})


# --- the fold ---------------------------------------------------------------------


def token_ids(ranks: dict[bytes, int]) -> list[list[tuple[str, int]]]:
    """The rank map as small maps, by a hash of the bytes.

    Bytes are written as the characters of the same number.
    """
    buckets: list[list[tuple[str, int]]] = [[] for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % RANK_BUCKETS].append((text, rank))
    return buckets


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(shifts, table): the rank of every two ids whose bytes together have one.

    The parts of a word always have ids, so a merge need not look at bytes. The pair
    (left, right) is in the table at shifts[left] + right, as left * IDS + rank, all ids and
    ranks counted from 1: the rows of a sparse matrix laid over each other, each shifted to
    where it meets no other. Gaps are 0.
    """
    rows: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                rows.setdefault(left + 1, {})[right + 1] = rank + 1
    shifts = [0] * (max(ranks.values(), default=0) + 2)
    table = [0] * len(shifts)
    taken, start, size = np.zeros(len(shifts), bool), 0, 0
    for left, row in sorted(rows.items(), key=lambda entry: -len(entry[1])):
        rights = np.array(list(row))
        offsets, tried = rights - rights.min(), 64
        if len(row).bit_length() != size:
            size, start = len(row).bit_length(), 0
        while True:
            if (reach := start + tried + offsets.max() + 1) >= len(taken):
                taken = np.concatenate([taken, np.zeros(reach, bool)])
            begins = start + np.flatnonzero(~taken[start : start + tried])
            for offset in offsets:
                begins = begins[~taken[begins + offset]]
            if len(begins):
                break
            start, tried = start + tried, 2 * tried
        # Rows of about one size go behind each other: the search does not begin anew.
        start = int(begins[0])
        taken[start + offsets] = True
        shifts[left] = start - int(rights.min())
        table += [0] * (start + int(offsets.max()) + 1 - len(table))
        for right, rank in row.items():
            table[shifts[left] + right] = left * IDS + rank
    return shifts, table


class Tables:
    """What a fold looks up, in the columns of one row.

    Spark hands the row to the tasks as the value of a scalar subquery. As literals its numbers
    would stand in every plan, and Spark keeps the text of each plan that ran on the driver.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= IDS - 1:
            raise ValueError(f"ranks must be below {IDS - 1}")
        shifts, table = pair_table(ranks)
        row = {
            "shifts": shifts,
            "table": table,
            "tokens": token_ids(ranks),
            "octets": [ranks[bytes([octet])] + 1 for octet in range(256)],
        }
        self.row = spark.createDataFrame(pa.table({"tables": pa.array([row], TABLES)}))

    def beside(self, rows: DataFrame) -> DataFrame:
        """The rows with the tables as a column, for one use of it in the next step.

        A subquery may not be stated within a higher-order function; Spark puts it there itself
        where the column is used once, so that no row holds the tables.
        """
        return rows.withColumn("tables", self.row.scalar())


def with_tables(result: Callable[..., Column]) -> Column:
    """``result`` of shifts, table, tokens and octets, which are looked up once a row."""

    def given(found: list[Column], names: list[str], tables: Column) -> Column:
        if not names:
            return result(*found)
        return _let(tables.getField(names[0]), lambda value: given([*found, value], names[1:], tables))

    return _let(F.col("tables"), lambda tables: given([], [field.name for field in TABLES], tables))


def folded(word: Column, shifts: Column, table: Column, tokens: Column, octets: Column) -> Column:
    """Ids of a word (binary): merge the lowest-ranked adjacent pair while there is one.

    A word that has a rank itself is that id, as in the library.
    """
    text = F.decode(word, "ISO-8859-1")
    own = _let(
        F.crc32(text.cast("binary")).bitwiseAND(RANK_BUCKETS - 1).cast("int"),
        lambda bucket: F.try_element_at(F.get(tokens, bucket), text),
    )
    merges = _let(text, lambda text: _folded(text, shifts, table, octets))
    return _let(own, lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(merges))


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is computed once.

    ``F.get`` would find out the type of ``result`` anew for every row. So do sums and
    products with what they are made of; below, these have variables, and long numbers are put
    together by bits.
    """
    return F.element_at(F.transform(F.array(value), result), 1)


def _folded(text: Column, shifts: Column, table: Column, octets: Column) -> Column:
    # A part is one number: the rank of the pair it begins, below it the part's place, and
    # below that its id. The least number is then the first pair of lowest rank. Ids and ranks
    # count from 1 here, as in the table.
    def part(rank: Column, place: Column, id: Column) -> Column:
        return F.shiftleft(rank, PART_BITS).bitwiseOR(place).bitwiseOR(id)

    def id_of(part: Column) -> Column:
        return part.bitwiseAND(IDS - 1)

    def place_of(part: Column) -> Column:
        return part.bitwiseAND((1 << PART_BITS) - IDS)

    def rank(left: Column, right: Column) -> Column:
        """IDS if there is none: a gap or another row's entry, less this row, is at least that; null counts for nothing."""
        entry = F.get(table, F.get(shifts, left) + right)
        return F.least(entry.bitwiseXOR(F.shiftleft(left, ID_BITS)), F.lit(IDS).cast("long"))

    def merged(parts: Column, lowest: Column, whole: Column, at: Column) -> Column:
        """Merge part ``at`` (from 0) with the next; only the pairs beside them change."""
        before = F.get(parts, at - 1)
        left = part(rank(id_of(before), whole), place_of(before), id_of(before))
        here = part(rank(whole, id_of(F.get(parts, at + 2))), place_of(lowest), whole)
        return F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2),
            lambda i: (
                F.when(i > at, F.get(parts, i + 1) - IDS)
                .when(i == at, here)
                .when(i + 1 == at, left)
                .otherwise(F.get(parts, i))
            ),
        )

    def step(parts: Column, _: Column) -> Column:
        def merge(lowest: Column) -> Column:
            # array_position would leave its loop by an exception, which takes long.
            at = F.shiftright(place_of(lowest), ID_BITS).cast("int")
            whole = F.shiftright(lowest, PART_BITS)
            one_less = _let(at, lambda at: _let(whole, lambda whole: merged(parts, lowest, whole, at)))
            return F.when(lowest < IDS << PART_BITS, one_less).otherwise(parts)

        return _let(F.array_min(parts), merge)

    def parts(ids: Column) -> Column:
        def octet(id: Column, i: Column) -> Column:
            return part(rank(id, F.get(ids, i + 1)), F.shiftleft(i.cast("long"), ID_BITS), id)

        return F.transform(ids, octet)

    end = F.length(text)
    ids = F.transform(
        F.sequence(F.lit(1), end), lambda i: F.get(octets, F.ascii(F.substring(text, i, F.lit(1))))
    )
    # A word of one byte has no pair, and no round that counts.
    rounds = F.sequence(F.lit(1), F.greatest(end - 1, F.lit(1)))
    merges = F.aggregate(rounds, _let(ids, parts), step)
    return F.transform(merges, lambda part: id_of(part).cast("int") - 1)


# --- words ------------------------------------------------------------------------


class Numbers(dict):
    """Numbers of words: places of the frequent ones, and behind them the others as they are met.

    The frequent words stay one array; as single strings they would be most of a worker. They
    are found by their hashes, in order: a hash table of Arrow's would be built for every look-up.
    """

    def __init__(self, frequent: pa.Array):
        super().__init__()
        self.words, self.frequent = frequent, len(frequent)
        hashes = np.empty(self.frequent, np.int64)
        for at in range(0, self.frequent, HASHED_WORDS):
            hashes[at : at + HASHED_WORDS] = self._hashes(frequent.slice(at, HASHED_WORDS).to_pylist())
        self.places = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.places]

    def __missing__(self, word: str) -> int:
        number = self[word] = self.next
        return number

    @property
    def next(self) -> int:
        return self.frequent + len(self)

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words))

    def of(self, words: list[str]) -> np.ndarray:
        numbers, others = np.zeros(len(words), np.int32), np.arange(len(words))
        if self.frequent:
            at = np.searchsorted(self.hashes, self._hashes(words))
            numbers = self.places[np.minimum(at, self.frequent - 1)]
            # A frequent word that another one's hash hides is numbered as it is met.
            found = pc.equal(self.words.take(pa.array(numbers)), pa.array(words, pa.string()))
            others = np.flatnonzero(~found.to_numpy(zero_copy_only=False))
        met = (words[at] for at in others.tolist())
        numbers[others] = np.fromiter(map(self.__getitem__, met), np.int32, len(others))
        return numbers

    def since(self, number: int) -> list[str]:
        """The words from this number on, of those that are not frequent."""
        return list(islice(reversed(self), self.next - number))[::-1]


def word_numbers(pattern: str, numbers: Numbers) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to the numbers of their words, and how many each text has.

    The split pattern never lets a word run from a visible character into white space, so
    texts are cut before every single space that a visible character follows. Of the parts
    of all texts each distinct one is looked at once, and all of them in one search.
    """
    import regex

    words = regex.compile(pattern).findall

    def parted(parts: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of parts that each follow a space and begin with a visible character, and how many each has."""
        found = words("".join([" " + part for part in parts]))
        begins = np.flatnonzero(np.fromiter((word[0] == " " for word in found), bool, len(found)))
        if len(begins) != len(parts):  # white space to one of the two only
            return listed([words(" " + part) for part in parts])
        return found, np.diff(begins, append=len(found))

    def listed(lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
        return list(chain.from_iterable(lists)), np.fromiter(map(len, lists), np.int64, len(lists))

    def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts.fill_null(""), " ")
        coded = lists.flatten().dictionary_encode()
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        index, parts = coded.indices.to_numpy(), coded.dictionary
        later = np.ones(len(index), bool)
        later[starts] = False
        # White space that hangs together: such a text is not cut.
        size = pc.binary_length(parts).to_numpy()
        bound = (size == 0) | (size != pc.binary_length(pc.utf8_ltrim_whitespace(parts)).to_numpy())
        whole = np.logical_or.reduceat(bound[index] & later, starts)
        later &= np.repeat(~whole, lists.value_lengths().to_numpy())
        used = np.zeros(len(parts), bool)
        used[index[later]] = True
        firsts, first_lengths = listed([
            words((texts[at].as_py() or "") if uncut else parts[index[start]].as_py())
            for at, (uncut, start) in enumerate(zip(whole.tolist(), starts.tolist(), strict=True))
        ])
        rest, rest_lengths = parted(parts.filter(pa.array(used)).to_pylist())
        # The first runs of the texts come before those of the other parts.
        runs = Runs(numbers.of(firsts + rest), np.concatenate([first_lengths, rest_lengths]))
        places = (np.cumsum(used) + (len(starts) - 1))[index]
        places[starts] = np.arange(len(starts))
        later[starts] = True
        lengths = np.add.reduceat(np.where(later, runs.lengths[places], 0), starts)
        return runs.joined(places[later]), lengths

    return numbered_words


def numbered(
    docs: DataFrame, pattern: str, most_words: int = CHUNK_WORDS, frequent: pa.Array | None = None
) -> DataFrame:
    """Documents as numbers of words, in chunks; and the words that are new in each.

    Every chunk numbers the ``frequent`` words first; they are new in none.

    ``low`` and ``high`` are the halves of the numbers, ``high`` is null where all are 0;
    ``words`` are numbered from ``first`` on. Documents that are looked at together state
    their words at the first of them.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunk, chars = TaskContext.get().partitionId() << 32, 0, 0
        numbers = Numbers(pa.array([], pa.string()) if frequent is None else frequent)
        numbers_of = word_numbers(pattern, numbers)
        for doc_ids, texts, size in _runs_of_texts(batches, min(most_words**2 // WORDS_SQUARED, CHUNK_CHARS)):
            if len(numbers) >= most_words or chars >= CHUNK_CHARS:
                chunk, chars = chunk + 1, 0
                numbers.clear()
            chars += size
            first = numbers.next
            flat, lengths = numbers_of(texts)
            # Arrow keeps what a group took; a worker would be half as large again.
            pa.default_memory_pool().release_unused()
            halves = flat.astype("<u4").view("<u2").reshape(-1, 2)
            ends = np.cumsum(lengths).tolist()
            lows, highs = [], []
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                lows.append(halves[start:end, 0].tobytes())
                highs.append(halves[start:end, 1].tobytes() if halves[start:end, 1].any() else None)
            new = [word.encode() for word in numbers.since(first)]
            others = len(ends) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + chunk] * len(ends), pa.int64()), doc_ids, pa.array(lows, pa.binary()),
                    pa.array(highs, pa.binary()), pa.array([first] + [numbers.next] * others, pa.int32()),
                    pa.array([new] + [[]] * others, pa.list_(pa.binary())),
                ],
                ["chunk", "doc_id", "low", "high", "first", "words"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(split, NUMBERED)


def _runs_of_texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array, int]]:
    """(doc_ids, texts, characters) of consecutive rows; more than ``most`` characters in single rows only."""
    held, chars = [], 0
    for batch in batches:
        start = 0
        for at, size in enumerate(pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()):
            if chars and chars + size > most:
                held.append(batch.slice(start, at - start))
                yield *_together(held), chars
                held, start, chars = [], at, 0
            chars += size
        held.append(batch.slice(start))
    if any(rows.num_rows for rows in held):
        yield *_together(held), chars


def _together(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([rows.column(i) for rows in batches]) for i in (0, 1)]


def with_ids(chunks: DataFrame, tables: Tables) -> DataFrame:
    """Chunks with the ids of their new words; null for words beyond FOLD_BYTES, which are listed."""
    short = lambda word: F.octet_length(word) <= FOLD_BYTES
    ids = with_tables(
        lambda *found: F.transform("words", lambda word: F.when(short(word), folded(word, *found)))
    )
    long = F.filter("words", lambda word: ~short(word))
    return tables.beside(chunks).select(*chunks.columns, ids.alias("ids"), long.alias("long"))


def frequent_words(
    docs: DataFrame, pattern: str, ranks: dict[bytes, int], tables: Tables | None = None
) -> pa.Table:
    """(word, ids) of at most FREQUENT_WORDS words that occur most in a sample, folded by Spark."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(every)) == 0)
    words = numbered(sample, pattern).select(F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts.where(F.octet_length("word") <= FOLD_BYTES), "word-counts")
    left, chosen = FREQUENT_WORDS, F.lit(True)
    # One row per number of occurrences, at most as many as the sample has chunks.
    for n, total in counts.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.desc("n")).collect():
        if total > left:
            # Of the words that occur n times, a share that fits.
            share = F.pmod(F.xxhash64("word"), F.lit(1000)) < int(950 * left / total)
            chosen = (F.col("n") > n) | ((F.col("n") == n) & share)
            break
        left -= total
    words = counts.where(chosen).repartition(SAMPLE_TASKS, "word")
    tables = tables or Tables(docs.sparkSession, ranks)
    ids = with_tables(lambda *found: folded(F.col("word"), *found))
    return tables.beside(words).select("word", ids.alias("ids")).toArrow()


# --- texts ------------------------------------------------------------------------


def by_parts(word_ids: Callable[[str], bytes], pattern: str) -> Callable[[str], bytes]:
    """A function that joins what the words of a text give; parts that repeat are kept."""
    import regex

    words = regex.compile(pattern).findall

    def part_ids(part: str) -> bytes:
        return b"".join([word_ids(word) for word in words(part)])

    cache = PartCache(part_ids, CACHE_ENTRIES)

    def encode(text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return b"".join([part_ids(first), *map(cache.__getitem__, rest)])
        except TypeError:  # a part without ids of its own: white space that hangs together
            return part_ids(text)

    return encode


def text_encoder(vocabulary: dict[bytes, bytes], ranks: dict[bytes, int], pattern: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers.

    For single texts beside Spark: words that the vocabulary lacks go to the library. No
    query encodes by it.
    """
    encoder = encoding(ranks, pattern)

    def word_ids(word: str) -> bytes:
        ids = vocabulary.get(word.encode())
        return ids if ids is not None else as_bytes(encoder.encode_ordinary(word))

    return by_parts(word_ids, pattern)


def _appended(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``more`` behind the values: in the room behind them, or in a new array with room."""
    room, size = values.base, len(values) + len(more)
    if not isinstance(room, np.ndarray) or not room.flags.writeable or len(room) < size:
        room = np.empty(size + size // 2, values.dtype)
        room[: len(values)] = values
    room[len(values) : size] = more
    return room[:size]


class Runs:
    """Runs of one flat array, by number: joins the runs of many numbers at once."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, lists: pa.ListArray) -> Runs:
        return cls(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))

    def extended(self, more: Runs) -> Runs:
        """These runs and those of ``more`` behind them; an array with room is written to in place."""
        longer = object.__new__(Runs)
        longer.flat = _appended(self.flat, more.flat)
        longer.lengths = _appended(self.lengths, more.lengths)
        longer.starts = _appended(self.starts, more.starts + len(self.flat))
        return longer

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = self.starts[numbers] - ends + lengths
        return self.flat[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes by the ranks of a file, which go with every task."""

    def __init__(self, docs: DataFrame, ranks_path: str, pattern: str):
        small_batches(docs.sparkSession)
        self.docs, self.ranks, self.pattern = docs, read_ranks(ranks_path), pattern

    @property
    def words(self) -> dict[bytes, bytes]:
        """The folded words of the codec's documents, for checks on a small corpus."""
        chunks = with_ids(numbered(self.docs, self.pattern), Tables(self.docs.sparkSession, self.ranks))
        pairs = chunks.select(F.explode(F.arrays_zip("words", "ids")).alias("pair"))
        rows = pairs.where("pair.ids IS NOT NULL").select("pair.*")
        return {bytes(r.words): as_bytes(r.ids) for r in rows.distinct().collect()}

    def _by_chunk(
        self, docs: DataFrame, result: Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch], schema: str
    ) -> DataFrame:
        """What ``result`` makes of doc_ids and ids, of documents in the order of their chunks."""
        ranks, pattern = self.ranks, self.pattern
        tables = Tables(docs.sparkSession, ranks)
        frequent = frequent_words(docs, pattern, ranks, tables)
        # As arrays: single words would take many times their memory here, and more in a pickle.
        known_ids = frequent.column("ids").combine_chunks()
        words = frequent.column("word").combine_chunks().cast(pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = runs = Runs.of(known_ids)
            chunk = None
            for batch in batches:
                chunks = batch.column("chunk").to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist()] if len(chunks) else []
                for start, end in zip(starts, [*starts[1:], len(chunks)], strict=True):
                    rows = batch.slice(start, end - start)
                    if chunk != chunks[start]:
                        chunk, runs = chunks[start], known
                    # Words are numbered in the order of a chunk's rows.
                    if rows.column("first")[0].as_py() != len(runs.lengths):
                        raise ValueError("rows of a chunk came in another order")
                    ids = rows.column("ids").flatten()
                    if ids.null_count:
                        library = encoding(ranks, pattern).encode_ordinary
                        long = iter(rows.column("long").flatten().to_pylist())
                        all_ids = [library(next(long).decode()) if i is None else i for i in ids.to_pylist()]
                        ids = pa.array(all_ids, ids.type)
                    runs = runs.extended(Runs.of(ids))
                    halves = zip(rows.column("low").to_pylist(), rows.column("high").to_pylist(), strict=True)
                    texts = [runs.joined(_whole(low, high)).astype("<u4") for low, high in halves]
                    yield result(rows.column("doc_id"), texts)

        chunks = with_ids(numbered(docs, pattern, frequent=words), tables)
        return chunks.select("chunk", "doc_id", "low", "high", "first", "ids", "long").mapInArrow(run, schema)

    def encoded(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""

        def result(doc_ids: pa.Array, texts: list[np.ndarray]) -> pa.RecordBatch:
            ids = pa.array([ids.tobytes() for ids in texts], pa.binary())
            return pa.RecordBatch.from_arrays([doc_ids, ids], ["doc_id", "ids"])

        return self._by_chunk(docs, result, ENCODED)

    def decoded(self, rows: DataFrame) -> DataFrame:
        """(doc_id, bytes) of encoded rows."""
        pieces = _pieces(self.ranks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc_ids, ids in _slices(batches):
                decoded = [decode(np.frombuffer(i, "<u4"), pieces) for i in ids]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(decoded, pa.binary())], ["doc_id", "bytes"])

        return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """Per row: number of ids, and digests of the ids and of what they decode to."""
        pieces = _pieces(self.ranks)

        def result(doc_ids: pa.Array, texts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.array([len(ids) for ids in texts], pa.int64()),
                    pa.array([sha256(ids.tobytes()).hexdigest() for ids in texts], pa.string()),
                    pa.array([sha256(decode(ids, pieces)).hexdigest() for ids in texts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return self._by_chunk(docs, result, ROUND_TRIP)


def _whole(low: bytes, high: bytes | None) -> np.ndarray:
    """Numbers from their halves."""
    numbers = np.frombuffer(low, "<u2").astype(np.int64)
    return numbers if high is None else numbers + (np.frombuffer(high, "<u2").astype(np.int64) << 16)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def _pieces(ranks: dict[bytes, int]) -> pa.BinaryArray:
    """Bytes by id."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def decode(ids: np.ndarray, pieces: pa.BinaryArray) -> bytes:
    _, ends, data = pieces.take(pa.array(ids)).buffers()
    return data[: np.frombuffer(ends, np.int32)[len(ids)]].to_pybytes() if len(ids) else b""
