import random
from collections import Counter

import numpy as np
import public_tokenizers as P

from paygrain.llm import byte_bpe, queries
from tests.llm import brute

DOCS = "doc_id long, text string"


def lower(rng, least, most):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(least, most)))


def words_of(texts):
    import regex

    return {w.encode() for t in texts for w in regex.findall(P.PATTERN, t or "")}


def test_every_distinct_word_is_folded_by_spark(spark):
    rng = random.Random(5)
    rare = [" ".join(lower(rng, 3, 9) for _ in range(600)) for _ in range(30)]
    long = [lower(rng, 33, 90), "x" * 700, "Ünïcödé" * 20, "漢字仮名" * 12]
    texts = [*rare, *long, "the the  the\n\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    codec, encoder = byte_bpe.Codec(docs, queries.RANKS, P.PATTERN), brute.byte_encoder()
    assert len(words_of(texts)) > 16_384
    assert codec.words.keys() == words_of(texts)
    for word, ids in codec.words.items():
        assert np.frombuffer(ids, "<u4").tolist() == encoder.encode_ordinary(word.decode())


def test_texts_are_put_together_from_folded_words_alone(spark):
    """With ranks of bytes and two pairs only, no library vocabulary can give these ids."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    docs = spark.createDataFrame([(1, "abababab cab"), (2, "a"), (None, "ba")], DOCS)
    codec = byte_bpe.Codec(docs, queries.RANKS, P.PATTERN)
    codec.ranks = ranks
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in codec.encoded(docs).collect()}
    assert got == {1: [257, 257, 32, ord("c"), 256], 2: [97], None: [98, 97]}


def test_chunks_number_their_words_whole(spark):
    rng = random.Random(6)
    texts = [" ".join(lower(rng, 1, 2) for _ in range(40)) for _ in range(50)]
    texts.append(" ".join(f"w{i}" for i in range(70_000)))  # more words than a chunk should have
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(2)
    rows = byte_bpe.numbered(docs, P.PATTERN, most_words=64).collect()
    assert len({r.chunk for r in rows}) > 10
    words = {}
    for r in rows:
        words.setdefault(r.chunk, {}).update({r.first + i: bytes(w) for i, w in enumerate(r.words)})
    for r in rows:
        numbers = byte_bpe._whole(r.low, r.high)
        assert b"".join(words[r.chunk][n] for n in numbers.tolist()).decode() == texts[r.doc_id]
    assert any(r.high is not None for r in rows)
    got = byte_bpe.Codec(docs, queries.RANKS, P.PATTERN).round_trip(docs)
    assert Counter(map(tuple, got.collect())) == Counter(brute.byte_bpe(list(enumerate(texts))))


def test_neither_texts_nor_ids_of_documents_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"word{i} and the rest") for i in range(20)], DOCS)
    out = byte_bpe.Codec(docs, queries.RANKS, P.PATTERN).round_trip(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partitioning(" not in plan
    assert plan.count("MapInArrow") == 2


def test_what_a_fold_looks_up_stands_in_no_plan_and_no_row(spark, monkeypatch):
    """The driver keeps the text of every plan; ranks as literals made it some 3 million characters."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    docs = spark.createDataFrame([(i, f"word{i} and the rest") for i in range(20)], DOCS)
    plans, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: plans.append(text(df)) or to_arrow(df))
    plans.append(text(byte_bpe.Codec(docs, queries.RANKS, P.PATTERN).round_trip(docs)))
    assert len(plans) == 2
    for plan in plans:
        assert len(plan) < 50_000
        assert "Subquery" in plan
        assert " AS tables#" not in plan


def test_words_are_folded_alike_whether_known_beforehand_or_not(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(lower(rng, 1, 4) for _ in range(60)) for _ in range(60)]
    texts += ["x" * 1100 + " " + "é" * 700, None, "", " \n the"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    want = Counter(brute.byte_bpe(list(enumerate(texts))))
    for most, sample in ((0, 1 << 15), (50, 1 << 15), (700_000, 8)):
        monkeypatch.setattr(byte_bpe, "FREQUENT_WORDS", most)
        monkeypatch.setattr(byte_bpe, "SAMPLE_DOCS", sample)
        known = byte_bpe.frequent_words(docs, P.PATTERN, byte_bpe.read_ranks(queries.RANKS))
        assert known.num_rows <= most
        got = byte_bpe.Codec(docs, queries.RANKS, P.PATTERN).round_trip(docs)
        assert Counter(map(tuple, got.collect())) == want


def test_pairs_are_looked_up_in_one_place():
    """Every two ids with a common rank are at their place, and no others are."""
    ranks = byte_bpe.read_ranks(queries.RANKS)
    few = {piece: rank for piece, rank in ranks.items() if rank < 2000}
    shifts, table = byte_bpe.pair_table(few)

    def rank(left, right):
        at = shifts[left + 1] + right + 1
        entry = table[at] if 0 <= at < len(table) else 0
        return (entry ^ (left + 1) << byte_bpe.ID_BITS) - 1

    pieces = sorted(few, key=few.get)
    for left in range(0, 2000, 7):
        for right in range(2000):
            want, got = few.get(pieces[left] + pieces[right]), rank(left, right)
            assert got == want if want is not None else got >= byte_bpe.IDS - 1


def test_texts_are_split_by_their_distinct_parts():
    import pyarrow as pa
    import regex

    spaces = [" ", "  ", "\n", " \n", "\n ", "\t ", " ", "  ", "\x1c", " \x1f", "​ ", "\u0085 "]
    rng = random.Random(9)
    words = ["the", "l'été", "don't", "'s", "42", "a1", "…!", "漢字", "\x00"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", *spaces]) for _ in range(12)) for _ in range(400)]
    texts += [None, "", " ", "  ", " the", "\nthe the ", "the"]
    frequent = ["the", " the", "never"]
    numbers = byte_bpe.Numbers(pa.array(frequent))
    flat, lengths = byte_bpe.word_numbers(P.PATTERN, numbers)(pa.array(texts))
    found = [regex.findall(P.PATTERN, text or "") for text in texts]
    known = frequent + numbers.since(3)
    assert [known[number] for number in flat] == [word for each in found for word in each]
    assert lengths.tolist() == [len(each) for each in found]
    assert set(known) == {word for each in found for word in each} | {"never"}


def test_frequent_words_of_one_hash_are_numbered_as_they_are_met(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe.Numbers, "_hashes", staticmethod(lambda words: np.array([len(w) for w in words])))
    numbers = byte_bpe.Numbers(pa.array(["the", "of", "and", "is"]))
    words = ["the", "and", "of", "is", "a", "never", "and", "is", "the"]
    got = numbers.of(words).tolist()
    known = ["the", "of", "and", "is", *numbers.since(4)]
    assert [known[number] for number in got] == words
    assert len(numbers) == 4  # one of each two frequent words with a hash, and the others
    assert byte_bpe.Numbers(pa.array([], pa.string())).of(words).tolist() == [0, 1, 2, 3, 4, 5, 1, 3, 0]
