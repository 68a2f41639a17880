"""Spelling variants: words one edit apart, grouped under their most frequent form.

Candidates come from a reduced alphabet: letters are hashed to a few symbols, so one edit
of a word is at most one edit of its reduced word. The one-edit neighbourhood of every
distinct reduced word is joined with the vocabulary of reduced words; the words behind
each pair of reduced words are then verified by the edit distance of the words as they
are. An insertion is a deletion seen from the longer word, and a replacement is seen from
both words, so a neighbourhood is written out as deletions and replacements by smaller
symbols: every pair of reduced words meets exactly once.

A pair of reduced words that many words share would be a pair of large blocks. Its words
(MOST_PAIRS) go to the same join over an alphabet of all letters instead, in which every
reduced word is one word and nothing is left to verify; so the work follows the number
of words and of near pairs, and nothing is dropped.

Cases: null and letterless texts have no words; a null doc_id counts as one of no
characters where ids enter; repeated rows count each time; ties take the smallest word
in code-point order; an empty table gives an empty result; texts of any length are read
whole, one at a time; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrain.llm.store import saved

LEAST_LENGTH = 5
LEAST_COUNT = 3
# A form must occur so many times as often as its variant.
LEAST_RATIO = 2
# One run in so many (by hash) loses a letter.
DAMAGED_EVERY = 97
SYMBOLS = 8
# Word pairs of two reduced words that are compared one by one.
MOST_PAIRS = 1 << 12
# Distinct words that a task counts before it passes them on.
HELD_WORDS = 1 << 18

# Lower-cased letters: a-z and the code points from U+00C0 to U+00FF.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
# In Latin-1, letters stay (A-Z as a-z) and all else becomes a space.
_LETTERS_ONLY = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case, in Latin-1.

    What Latin-1 cannot hold is no letter here and becomes a question mark.
    """
    return text.encode("latin-1", "replace").translate(_LETTERS_ONLY).split()


def damaged(run: bytes, id_crc: int) -> bytes:
    """The run, or one without a letter if the CRC-32 of id and run says so."""
    utf8 = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(utf8, id_crc)
    if h % DAMAGED_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least LEAST_LENGTH letters."""

    def passed(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = [word.decode("latin-1") for word in counts]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for key, value in zip(*batch.columns, strict=True):
                id_crc = zlib.crc32(key.as_py().encode() + b":")
                for run, n in Counter(runs(value.as_py() or "")).items():
                    word = damaged(run, id_crc)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield passed(counts)
                    counts.clear()
        yield passed(counts)

    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id")
    parts = docs.select(key, F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def symbols(count: int) -> str:
    """The symbols of a reduced alphabet; with all letters, the letters themselves."""
    return LETTERS if count >= len(LETTERS) else LETTERS[:count]


def reduced(word: Column, count: int) -> Column:
    """The word with each letter replaced by its symbol, dealt by hash."""
    alphabet = symbols(count)
    if alphabet == LETTERS:
        return word
    dealt = "".join(alphabet[zlib.crc32(letter.encode()) % count] for letter in LETTERS)
    return F.translate(word, LETTERS, dealt)


def neighbours(word: Column, count: int) -> Column:
    """One edit away from a reduced word: deletions, and replacements by smaller symbols."""
    alphabet = F.array(*[F.lit(symbol) for symbol in sorted(symbols(count))])

    def edits(at: Column) -> Column:
        before, after = F.substring(word, 1, at - 1), F.substring(word, at + 1, F.length(word))
        smaller = F.filter(alphabet, lambda symbol: symbol < F.substring(word, at, 1))
        return F.array_append(
            F.transform(smaller, lambda symbol: F.concat(before, symbol, after)),
            F.concat(before, after),
        )

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), edits)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words (word, n) one edit apart, once, a < b."""
    keyed = saved(words.withColumn("key", reduced(F.col("word"), SYMBOLS)), "spelling-words")
    vocabulary = keyed.groupBy("key").agg(F.count("*").alias("size"))
    made = vocabulary.select(
        F.col("key").alias("a_key"),
        F.col("size").alias("a_size"),
        F.explode(neighbours(F.col("key"), SYMBOLS)).alias("b_key"),
    )
    own = vocabulary.where("size > 1").select(
        F.col("key").alias("a_key"), F.col("key").alias("b_key"), (F.col("size") * F.col("size")).alias("pairs")
    )
    blocks = saved(
        made.join(vocabulary.select(F.col("key").alias("b_key"), F.col("size").alias("b_size")), "b_key")
        .select("a_key", "b_key", (F.col("a_size") * F.col("b_size")).alias("pairs"))
        .unionByName(own),
        "spelling-blocks",
    )

    one, two = (
        keyed.select(F.col("key").alias(f"{x}_key"), F.col("word").alias(x), F.col("n").alias(f"n{x}"))
        for x in "ab"
    )
    compared = (
        blocks.where(F.col("pairs") <= MOST_PAIRS)
        .join(one, "a_key")
        .join(two, "b_key")
        .where((F.col("a_key") != F.col("b_key")) | (F.col("a") < F.col("b")))
        .where(F.levenshtein("a", "b", 1) == 1)
        .select("a", "na", "b", "nb")
    )

    crowded = (
        blocks.where(F.col("pairs") > MOST_PAIRS)
        .select(F.explode(F.array("a_key", "b_key")).alias("key"))
        .distinct()
    )
    rest = keyed.join(crowded, "key", "left_semi")
    edits = F.explode(neighbours(F.col("word"), len(LETTERS))).alias("b")
    met = rest.select(F.col("word").alias("a"), F.col("n").alias("na"), edits).join(
        rest.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b"
    )
    pairs = compared.unionByName(met.select("a", "na", "b", "nb"))
    first, last = F.struct(F.col("a").alias("w"), F.col("na").alias("n")), F.struct(F.col("b").alias("w"), F.col("nb").alias("n"))
    ordered = pairs.select(F.least(first, last).alias("x"), F.greatest(first, last).alias("y"))
    return ordered.select(
        F.col("x.w").alias("a"), F.col("x.n").alias("na"), F.col("y.w").alias("b"), F.col("y.n").alias("nb")
    ).distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): each word and its most frequent near word.

    Without a near word that occurs LEAST_RATIO times as often, form and form_n are null.
    """
    both = pairs.select("a", "na", "b", "nb").unionByName(
        pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))
    )
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("rank"), F.col("b"))).alias("best")
    )
    often = -F.col("best.rank") >= LEAST_RATIO * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.b")).alias("form"),
        F.when(often, -F.col("best.rank")).alias("form_n"),
    )


def with_roots(rows: DataFrame) -> DataFrame:
    """Add ``root``: the end of the chain of forms; a word without a form is its own.

    Chains are halved by following the form of the form until none goes on. Each step
    of a chain at least doubles n, so few rounds are needed whatever the table.
    """
    rows = saved(rows, "spelling-forms")
    chains = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chains = saved(
            chains.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-chains",
        )
        if chains.where("moved").isEmpty():
            break
        chains = chains.drop("moved")
    return rows.join(chains.select("word", "root"), "word", "left").withColumn(
        "root", F.coalesce("root", "word")
    )


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words with LEAST_COUNT occurrences."""
    words = saved(word_counts(docs, doc_id, text).where(F.col("n") >= LEAST_COUNT), "spelling-counts")
    return with_roots(forms(words, near_pairs(words)))
