"""Decontamination, Merkle manifest and spelling variants against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paygrain.llm import decontaminate, merkle, queries, spelling
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, got, texts

LONG = [f"l{i}" for i in range(60)]
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank"),
    (1, "second text of the first id"),
    (2, "fox jumps over the lazy dog near the quiet river"),
    (3, "Lazy, dog!"),
    (None, "ÜBER straße"),
    (4, None),
    (5, " -- "),
    (6, "word word"),
    (7, " ".join(LONG)),
    (10, "solo"),
    (8, "a b a b a b a b a b a b"),
    (9, "word " * 12),
]


def suspects():
    rng = random.Random(8)
    words = sorted({w for _, t in ITEMS for w in brute.bench_words(t)}) + ["other", "İ", "x9"]
    rows = texts()
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            item = brute.bench_words(rng.choice(ITEMS)[1]) or ["none"]
            at = rng.randrange(len(item))
            parts += item[at : at + rng.randrange(1, 16)] if rng.random() < 0.7 else rng.choices(words, k=5)
        rows.append((100 + i, rng.choice([" ", "-", ", ", "\n"]).join(p.upper() if rng.random() < 0.2 else p for p in parts)))
    return rows + [rows[-1], (None, rows[-1][1])]


def plain(docs, items):
    found = brute.contaminated(docs, items)
    return Counter(
        (d, n, len(hit), len(names), brute.sha(",".join(sorted(names)).encode()), bool(hit)) for d, n, hit, names in found
    )


def digest(rows):
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    names = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return rows.select("row.doc_id", "n_words", hit, F.size("items"), names, F.size("spans") > 0)


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_decontamination_finds_every_window(spark, monkeypatch, block_words):
    """Also with several automata, items in pieces, and texts read in small blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    if block_words < 100:
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", 24)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 16)
    rows = suspects()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    blocks = decontaminate.automata(items)
    assert (blocks.count() > 2) == (block_words < 100)
    assert Counter(map(tuple, digest(decontaminate.matched(docs, blocks)).collect())) == plain(rows, ITEMS)


def test_decontamination_cuts_and_drops(spark, awkward, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = decontaminate.automata(benchmark.where("false"))
    assert got(decontaminate.decontaminated(awkward, nothing), *awkward.columns) == got(awkward, *awkward.columns)
    blocks = decontaminate.automata(benchmark.where("item_id = 7"))
    filler = "some words of its own, that fill more than half of this text. " * 3
    rows = [
        (1, f"Ä {filler}({' '.join(LONG[:12])})."),
        (2, " ".join(LONG[5:30])),
        (3, f"{filler}{' '.join(LONG[:9])}"),
        (4, f"{' '.join(LONG[:10])} {filler}" + "  ".join(LONG[20:30])),
        (5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(decontaminate.decontaminated(docs, blocks).collect())
    assert kept == {1: f"Ä {filler}().", 3: rows[2][1], 4: f" {filler}", 5: None}
    same = spark.createDataFrame([(1, "solo", 2, 3, 4)], "row int, text string, spans int, items int, cleaned int")
    alone = decontaminate.automata(benchmark.where("item_id = 10"))
    found = decontaminate.matched(same, alone)
    assert found.select("row.*").columns == same.columns and found.first()["items"] == ["10"]
    assert decontaminate.matched(empty, blocks).count() == 0


LEAVES = "doc_id long, source string, lang string, n_chars long, text string, leaf int"


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_of_awkward_rows(spark, monkeypatch, levels):
    """Trees of all small sizes; a third of null ids, repeated rows, nulls everywhere."""
    monkeypatch.setattr(merkle, "FOLD_LEVELS", levels)
    rng = random.Random(5)
    rows = [(d, s, lang, n, t) for d, t, lang, s, n, *_ in AWKWARD]
    for size in (1, 2, 3, 4, 9, 10, 28, 85):
        for i in range(size):
            doc_id = None if i % 3 == 2 else rng.randrange(-40, 400)
            rows.append((doc_id, f"é{size}", None if i % 5 else "en", i, f"line {i}\nof {rng.randrange(3)}"))
    rows += [(None, None, None, None, None)] * 5 + [(7, "hot", "en", 1, "same\n")] * 40
    df = spark.createDataFrame([(*r, 1) for r in rows], LEAVES).repartition(7)
    tampered = merkle.without_line_breaks(F.col("text"), F.col("doc_id"))
    found = merkle.manifest(df, tampered).drop("path")
    want = Counter(brute.merkle(rows))
    assert got(found, *found.columns) == want
    assert {row[-1] for row in want} == {True, False}
    for few in (rows[:1], rows[3:5]):
        found = merkle.manifest(spark.createDataFrame([(*r, 1) for r in few], LEAVES), tampered).drop("path")
        assert got(found, *found.columns) == Counter(brute.merkle(few))


def test_manifest_of_no_rows(empty):
    tampered = merkle.without_line_breaks(F.col("text"), F.col("doc_id"))
    assert merkle.manifest(empty, tampered).count() == 0


def misspelt():
    rng = random.Random(2)
    rows = texts() + [(20, "ÀÉÎ àéîöü Straße_straße×öl÷ ﬁxed naïvé x1y2 ABCDEfgh")]
    base = ["letter", "spelling", "variant", "straße", "abcdeb", "zzzzz"]
    for i in range(300):
        words = []
        for _ in range(rng.randrange(1, 30)):
            word = rng.choice(base[: 1 + i % 6])
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(word))
                put = rng.choice(["", "e", "é", "Z", "x"])
                word = word[:at] + put + word[at + rng.randrange(2) :]
            words.append(word)
        rows.append((None if i % 3 == 0 else i, " ".join(words)))
    return rows + rows[-5:]


@pytest.mark.parametrize(("symbols", "most"), [(8, 1 << 12), (2, 1 << 12), (1, 9), (8, 0)])
def test_variants_of_awkward_rows(spark, monkeypatch, symbols, most):
    """Also with alphabets so small, and limits so low, that words meet over all letters."""
    monkeypatch.setattr(spelling, "SYMBOLS", symbols)
    monkeypatch.setattr(spelling, "MOST_PAIRS", most)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = misspelt()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).repartition(3)
    found = spelling.variants(df)
    want = Counter(brute.spelling(rows))
    assert got(found, *found.columns) == want
    assert sum(row[3] is not None for row in want) > 20 and any(row[5] not in (row[0], row[3]) for row in want)


def test_variants_of_no_rows(empty):
    assert spelling.variants(empty).count() == 0
    assert queries.QUERIES["op13_spelling_variants"]
