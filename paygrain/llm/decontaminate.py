"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The items are cut into words and dealt into blocks of a bounded number of words; a task
builds one automaton of all word sequences of a block. Every document is then streamed
through it word by word: the state and the matched length tell the longest run of words
up to here that stands in some item. Wherever that run is as long as a window, the words
of the window are hit, and the state knows the items that hold it.

``matched`` gives the hit spans and items of every document; ``decontaminated`` cuts the
spans out of the texts and drops documents that are mostly benchmark.

An automaton travels to the tasks whole, so its size is bounded (BLOCK_WORDS). A larger
benchmark has several: the documents pass each in turn, and only the documents it hits
are written and merged by row. Long items are cut into pieces that overlap by a window
less one word, so every window stands whole in one piece.

Cases: null, empty and wordless texts have no words and no hits; an item without words is
never hit; items of one id count as one item, a null id as the id of no characters; a
window that stands in several items hits them all; an empty benchmark hits nothing; an
empty table gives an empty result; long texts are read in blocks of BLOCK_BYTES; all
columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paygrain.llm.store import saved

WINDOW = 10
# Words of one automaton: some 300 bytes each in a worker.
BLOCK_WORDS = 1 << 17
# Words of one piece of an item.
PIECE_WORDS = 1 << 12
# Bytes of a text whose words are held at a time.
BLOCK_BYTES = 1 << 20

# Lower case for A-Z, and a space for every byte that is no digit, letter or part of a
# character beyond ASCII.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")

_SPANS = "array<struct<start:long,stop:long>>"


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, some at a time."""
    start = 0
    while start < len(data):
        stop = start + BLOCK_BYTES
        while stop < len(data) and data[stop : stop + 1].translate(_PLAIN) != b" ":
            stop += 1
        yield data[start:stop].translate(_PLAIN).split()
        start = stop


class Automaton:
    """Suffix automaton of several word sequences, and what a match in it stands for."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.link, self.length, self._next = [-1], [0], [{}]
        names: dict[str, int] = {}
        coded = []
        for name, words in pieces:
            sequence = [self.ids.setdefault(word, len(self.ids)) for word in words]
            state = 0
            for word in sequence:
                state = self._extended(state, word)
            coded.append((names.setdefault(name, len(names)), sequence))
        self.names = list(names)
        self._mark(coded)
        size = len(self.ids)
        self.step = {s * size + w: t for s, row in enumerate(self._next) for w, t in row.items()}
        del self._next

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self._next.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _extended(self, last: int, word: int) -> int:
        """The state of ``last``'s sequence with one more word."""
        there = self._next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        state = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self._next[last]:
            self._next[last][word] = state
            last = self.link[last]
        if last >= 0:
            there = self._next[last][word]
            whole = self.length[there] == self.length[last] + 1
            self.link[state] = there if whole else self._split(last, word, there)
        return state

    def _split(self, before: int, word: int, state: int) -> int:
        """Shorter sequences of ``state`` get a state of their own, where they occur more often."""
        own = self._state(self.length[before] + 1, dict(self._next[state]), self.link[state])
        self.link[state] = own
        while before >= 0 and self._next[before].get(word) == state:
            self._next[before][word] = own
            before = self.link[before]
        return own

    def _mark(self, pieces: list[tuple[int, list[int]]]) -> None:
        """For each state the state of its last window, and the short items it ends with."""
        count = len(self.length)
        self.at_window, self.at_short = [-1] * count, [-1] * count
        self.holders: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        order = sorted(range(1, count), key=self.length.__getitem__)
        for state in order:
            if self.length[state] >= self.window:
                above = self.link[state]
                self.at_window[state] = state if self.length[above] < self.window else self.at_window[above]
        for name, sequence in pieces:
            state = 0
            for place, word in enumerate(sequence, 1):
                state = self._next[state][word]
                if place >= self.window:
                    self.holders.setdefault(self.at_window[state], set()).add(name)
            if len(sequence) < self.window:
                self.short.setdefault(state, []).append((len(sequence), name))
        for state in order:
            self.at_short[state] = state if state in self.short else self.at_short[self.link[state]]
        # Whether a match that reaches this state may end a window or a short item.
        self.alert = [w >= 0 or s >= 0 for w, s in zip(self.at_window, self.at_short, strict=True)]

    def found(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit spans of words (disjoint, in order), items hit."""
        word_id, step, size = self.ids.get, self.step.get, len(self.ids)
        link, length, alert = self.link, self.length, self.alert
        place, state, run = 0, 0, 0
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        items: set[int] = set()
        for words in word_blocks(data):
            for word in map(word_id, words):
                place += 1
                if word is None:
                    state = run = 0
                    continue
                there = step(state * size + word)
                while there is None:
                    # The root leads on with every word that has an id.
                    state = link[state]
                    run = length[state]
                    there = step(state * size + word)
                state = there
                run += 1
                if alert[state]:
                    longest = self._ended(state, run, windows, items)
                    if longest:
                        start = place - longest
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, place))
        for window in windows:
            items |= self.holders[window]
        return place, spans, items

    def _ended(self, state: int, run: int, windows: set[int], items: set[int]) -> int:
        """Note what ends here; the length of the longest window."""
        longest = 0
        if run >= self.window:
            windows.add(self.at_window[state])
            longest = self.window
        at = self.at_short[state]
        while at >= 0:
            for size, name in self.short[at]:
                if size <= run:
                    items.add(name)
                    longest = max(longest, size)
            at = self.at_short[self.link[at]]
        return longest


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans and what stands between them."""
    left, at, upto = [], 0, 0
    spans = iter(spans)
    start, stop = next(spans)
    for place, word in enumerate(_WORD.finditer(data.translate(_PLAIN)), 1):
        if place == start + 1:
            upto = word.start()
        if place == stop:
            left.append(data[at:upto])
            at = word.end()
            start, stop = next(spans, (-1, -1))
            if stop < 0:
                break
    return b"".join(left) + data[at:]


def _pieces(bench: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(name, words, n): items in pieces, words parted by single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = [w for block in word_blocks(value.as_py() or b"") for w in block]
                most = max(PIECE_WORDS, 2 * window)
                starts = range(0, max(len(words) - window + 1, 1), most - window + 1) if words else ()
                parts = [words[s : s + most] for s in starts]
                yield pa.RecordBatch.from_pydict(
                    {"name": [name.as_py()] * len(parts), "words": [b" ".join(p) for p in parts], "n": [len(p) for p in parts]},
                    pa.schema([("name", pa.string()), ("words", pa.binary()), ("n", pa.int64())]),
                )

    rows = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), text)
    return rows.mapInArrow(cut, "name string, words binary, n long")


def automata(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(block, automaton), written: an automaton for every BLOCK_WORDS words, about."""
    pieces = saved(_pieces(bench, item, text, window), "benchmark-pieces")
    blocks = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS)

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = [(n.as_py(), w.as_py().split(b" ")) for n, w in zip(group["name"], group["words"], strict=True)]
        made = pickle.dumps(Automaton(sorted(rows), window))
        return pa.table({"block": [key[0]], "automaton": pa.array([made], pa.binary())})

    block = F.pmod(F.xxhash64("name", "words"), F.lit(max(blocks, 1))).alias("block")
    dealt = pieces.select(block, "name", "words").groupBy("block")
    return saved(dealt.applyInArrow(build, "block long, automaton binary"), "benchmark-automata")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


def _batch(keys: pa.Array, found: list[tuple], cleaned: list[str | None]) -> pa.RecordBatch:
    spans = [[{"start": a, "stop": b} for a, b in row[1]] for row in found]
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array([row[0] for row in found], pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            pa.array([row[2] for row in found], pa.list_(pa.string())),
            pa.array(cleaned, pa.string()),
        ],
        ["row", "n_words", "spans", "items", "cleaned"],
    )


def _schema(rows: DataFrame) -> StructType:
    found = StructType.fromDDL(f"n_words long, spans {_SPANS}, items array<string>, cleaned string")
    return StructType([rows.schema["row"], *found])


def _streamed(rows: DataFrame, made: bytes, cut: bool, hits_only: bool = False) -> DataFrame:
    """Rows (row, text) streamed through one automaton."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(made)
        for batch in batches:
            taken, found, cleaned = [], [], []
            for at, value in enumerate(batch.column(1).cast(pa.binary())):
                data = value.as_py() or b""
                n_words, spans, items = automaton.found(data)
                if spans or not hits_only:
                    taken.append(at)
                    found.append((n_words, spans, [automaton.names[i] for i in items]))
                    cleaned.append(without_spans(data, spans).decode() if cut and spans else None)
            keys = batch.column(0)
            yield _batch(keys.take(pa.array(taken, pa.int64())) if hits_only else keys, found, cleaned)

    return rows.mapInArrow(search, _schema(rows))


def _gathered(rows: DataFrame, cut: bool) -> DataFrame:
    """Rows (row, text, spans, items) with what several automata found, as one would."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cleaned = [], []
            for value, pairs, items in zip(batch.column(1).cast(pa.binary()), *batch.columns[2:], strict=True):
                data = value.as_py() or b""
                spans = _merged([(p["start"], p["stop"]) for p in pairs.as_py() or ()])
                found.append((sum(map(len, word_blocks(data))), spans, items.as_py() or []))
                cleaned.append(without_spans(data, spans).decode() if cut and spans else None)
            yield _batch(batch.column(0), found, cleaned)

    return rows.mapInArrow(finish, _schema(rows))


def matched(docs: DataFrame, blocks: DataFrame, text: str = "text", cut: bool = False) -> DataFrame:
    """What the automata (``automata``) find in every row of ``docs``.

    Columns: row (all columns of docs), n_words, spans (hit words, from 0, stop excluded),
    items (ids as text), cleaned (the text without the spans; null unless ``cut`` and hit).
    """
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    numbers = [r.block for r in blocks.select("block").orderBy("block").collect()]

    def automaton(block: int) -> bytes:
        # One at a time is on the driver: each is of bounded size.
        return bytes(blocks.where(F.col("block") == block).first()["automaton"])

    if len(numbers) <= 1:
        made = automaton(numbers[0]) if numbers else pickle.dumps(Automaton([], WINDOW))
        return _streamed(docs.select(row, F.col(text).alias("text")), made, cut)

    keyed = saved(docs.select(row, F.monotonically_increasing_id().alias("id")), "documents")
    whole = F.col("row").getField(text).alias("text")
    texts = keyed.select(F.col("id").alias("row"), whole)
    hits = [saved(_streamed(texts, automaton(n), False, True), "hits") for n in numbers]
    found = (
        reduce(DataFrame.unionByName, hits)
        .groupBy(F.col("row").alias("id"))
        .agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    )
    return _gathered(keyed.join(found, "id", "left").select("row", whole, "spans", "items"), cut)


def decontaminated(
    docs: DataFrame, blocks: DataFrame, text: str = "text", least_words: int = WINDOW, most_share: float = 0.5
) -> DataFrame:
    """The documents, with their columns, without what they share with the benchmark.

    A document whose hit spans of at least ``least_words`` words hold more than
    ``most_share`` of its words is dropped; of others, all hit spans are cut out if one is
    that long. Shorter hits alone leave a document as it is.
    """
    rows = matched(docs, blocks, text, cut=True)
    size = F.col("spans.stop"), F.col("spans.start")
    long_words = F.aggregate(
        F.zip_with(*size, lambda stop, start: stop - start),
        F.lit(0).cast("long"),
        lambda total, n: total + F.when(n >= least_words, n).otherwise(0),
    )
    kept = rows.withColumn("_long", long_words).where(F.col("_long") <= most_share * F.col("n_words"))
    texts = F.when(F.col("_long") > 0, F.col("cleaned")).otherwise(F.col("row").getField(text))
    return kept.select(
        *[
            (texts if name == text else F.col("row").getField(name)).alias(name)
            for name in docs.columns
        ]
    )
