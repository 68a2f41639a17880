"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed letter n-grams; a linear layer turns
the mean into one score per language. Both are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows (SAMPLE_ROWS, expected; at most
twice as many), whose n-gram counts are made where the texts are, from whole texts. Part
of the sample is kept aside to calibrate a temperature and two bars:

* A softmax compares languages only, so it is sure of gibberish too. A text's familiarity
  is the mean log-likelihood ratio of its n-grams, their shares in the predicted language
  against equal shares. Its bar lies halfway between what kept-aside rows that were
  predicted right reach (LOW quantile) and what they reach in the languages that they are
  not in (HIGH quantile). The score is the softmax's chance times the chance of being
  known, which is one half at the bar.
* The threshold is the lowest score at which the share of errors among accepted texts
  stays within MAX_ERROR, never below LEAST_SCORE: no text under the bar is accepted.

Because the layers are linear, prediction needs two numbers per n-gram and language;
it runs over whole texts in blocks of code points, so a very long text costs no memory.

Cases: a null text or one without a letter is `und`, score 0 and rejected; ties between
languages go to the alphabetically first; without labelled rows everything is `und`; if
no kept-aside row is predicted right, everything is rejected;
rows with a null doc_id are learned from like others; repeated rows are predicted alike;
an empty table gives an empty result; other columns are kept, own names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from paygrain.llm.byte_units import once
from paygrain.llm.store import small_batches

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
DIMENSIONS = 16
SAMPLE_ROWS = 4000
EPOCHS = 6
# A small sample is gone through more often, up to about this many steps.
LEAST_STEPS = 4000
RATE = 0.2
MAX_ERROR = 0.02
LOW, HIGH, LEAST_SCORE = 0.01, 0.95, 0.5
# An n-gram's shares count a text as this many n-grams at most.
MOST_GRAMS = 4000
BLOCK_POINTS = 1 << 17
UNKNOWN = "und"
ADDED = ("lang_pred", "score", "accepted")


# --- features ---------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case, and whether it is a letter."""

    def make():
        points = range(0x110000)
        low = np.arange(0x110000, dtype=np.uint32)
        for i in points:
            small = chr(i).lower()
            if len(small) == 1:
                low[i] = ord(small)
        return low, np.fromiter((chr(i).isalpha() for i in points), bool, len(points))

    return once(("letters",), make)


def gram_buckets(points: np.ndarray, fresh: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the n-grams of every size, words marked at their edges.

    ``points`` are lower-case letters and 0 for everything else; n-grams have zeros at
    their ends only. Only those that begin in the first ``fresh`` positions count.
    """
    letter = points > 0
    count = len(points) if fresh is None else fresh
    mixed = points * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for n in SIZES:
        width = min(count, len(points) - n + 1)
        if width <= 0:
            continue
        if n <= 2:
            ok = letter[:width] | (letter[1 : width + 1] if n == 2 else False)
        else:
            ok = letter[1 : width + 1].copy()
            for k in range(2, n - 1):
                ok &= letter[k : k + width]
        at = np.flatnonzero(ok)
        code = np.full(len(at), np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF), np.uint32)
        for k in range(n):
            code = (code ^ mixed[at + k]) * np.uint32(0xC2B2AE35)
            code ^= code >> np.uint32(15)
        yield at, code & np.uint32(BUCKETS - 1)


def marked_points(marked: str) -> np.ndarray:
    """Lower-case letters of a string, 0 for everything else."""
    low, is_letter = _tables()
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(is_letter[codes], low[codes], 0).astype(np.uint32)


def text_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts' points one after the other, a 0 before and after each, and their starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    return marked_points("\0" + "\0".join(texts) + "\0"), starts


def long_text_grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``gram_buckets`` of one text in blocks that overlap by an n-gram."""
    marked = f"\0{text}\0"
    for at in range(0, len(marked), BLOCK_POINTS):
        block = marked[at : at + BLOCK_POINTS + max(SIZES) - 1]
        yield from gram_buckets(marked_points(block), BLOCK_POINTS)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A whole text's n-gram buckets and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for _, buckets in long_text_grams(text):
        total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used.astype(np.int32), total[used]


# --- model ------------------------------------------------------------------------


@dataclass
class Model:
    """weights, likely: per bucket and language; threshold: calibrated score to accept from."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    likely: np.ndarray
    temperature: float
    bar: float
    slope: float
    threshold: float

    def chances(self, means: np.ndarray, familiar: np.ndarray) -> np.ndarray:
        """Per language: its chance, times the chance that the text is in a known one."""
        chances = _softmax((means + self.bias) / self.temperature)
        best = familiar[np.arange(len(familiar)), chances.argmax(axis=1)]
        return chances / (1 + np.exp(np.clip(self.slope * (self.bar - best), -60, 60)))[:, None]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 0) -> Model:
    """Train on (language, buckets, counts) rows, then calibrate on every fifth of them."""
    languages = sorted({lang for lang, _, _ in rows})
    label = {lang: k for k, lang in enumerate(languages)}
    data = [(label[lang], b, (c / c.sum()).astype(np.float64)) for lang, b, c in rows if len(b)]
    held, used = data[::5], [row for i, row in enumerate(data) if i % 5]
    used = used or held
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer = random.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    epochs = max(EPOCHS, LEAST_STEPS // max(1, len(used)))
    steps, step = epochs * max(1, len(used)), 0
    for _ in range(epochs):
        for i in random.permutation(len(used)):
            k, buckets, shares = used[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = shares @ table[buckets]
            error = _softmax(mean @ layer + bias)
            error[k] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # Spread over its buckets so that the mean itself makes the whole step.
            table[buckets] -= rate * np.outer(shares / (shares @ shares), back)
    weights = table @ layer
    likely = _likely(used, len(languages))
    means = np.array([s @ weights[b] for _, b, s in held]).reshape(len(held), len(languages))
    familiar = np.array([s @ likely[b] for _, b, s in held]).reshape(len(held), len(languages))
    truth = np.array([k for k, _, _ in held], int)
    model = Model(languages, weights.astype(np.float32), bias, likely.astype(np.float32), 1.0, 0.0, 1.0, 1.0)
    _calibrate(model, means, familiar, truth)
    return model


def _likely(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int) -> np.ndarray:
    """Log ratio of each bucket's share in a language and an equal share."""
    counts = np.full((BUCKETS, languages), 0.5)
    for k, buckets, shares in rows:
        # The rarest n-gram of a text occurs once or more often.
        counts[buckets, k] += shares * min(1 / shares.min(), MOST_GRAMS)
    return np.log(counts / counts.sum(axis=0) * BUCKETS)


def _calibrate(model: Model, means: np.ndarray, familiar: np.ndarray, truth: np.ndarray) -> None:
    """Set temperature, bar, slope and threshold from kept-aside rows."""
    rows, scores = np.arange(len(truth)), means + model.bias
    right = scores.argmax(axis=1) == truth if len(truth) else np.zeros(0, bool)
    if not right.any():
        return
    choices = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(scores / t)[rows, truth] + 1e-12).mean() for t in choices]
    model.temperature = float(choices[int(np.argmin(losses))])
    low = np.quantile(familiar[rows, truth][right], LOW)
    other = np.arange(familiar.shape[1]) != truth[:, None]
    # N-grams of equal shares are no language: what is expected at the very least.
    high = max(0.0, np.quantile(familiar[other], HIGH)) if other.any() else 0.0
    model.bar = float(min(low, (low + high) / 2))
    model.slope = float(3 / max(low - model.bar, 0.1))
    chances = model.chances(means, familiar)
    best, wrong = chances.max(axis=1), ~right
    order = np.argsort(-best, kind="stable")
    errors = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= MAX_ERROR)
    lowest = 1.0 if not len(fine) else 0.0 if fine[-1] == len(order) - 1 else best[order[fine[-1]]]
    model.threshold = max(LEAST_SCORE, float(lowest))


def training_rows(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple]:
    """A bounded sample, equally large per language, as n-gram counts of whole texts.

    Rows are chosen by a hash of doc_id against each language's rate, so the choice does
    not depend on the order of the table.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return []
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_rows / len(sizes) / n)).otherwise(share)
    spread = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "lang")
    chosen = rows.withColumn("at", spread).where(
        F.pmod("at", F.lit(1 << 30)) < share * float(1 << 30)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                buckets, counts = bucket_counts(batch.column("text")[i].as_py())
                row = [[batch.column(c)[i].as_py()] for c in ("at", "doc_id", "lang")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[0], pa.int64()),
                        pa.array(row[1], pa.int64()),
                        pa.array(row[2], pa.string()),
                        pa.array([buckets.tobytes()], pa.binary()),
                        pa.array([np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes()], pa.binary()),
                    ],
                    ["at", "doc_id", "lang", "buckets", "counts"],
                )

    counted = chosen.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        count, "at long, doc_id long, lang string, buckets binary, counts binary"
    )
    taken = counted.orderBy("at", "doc_id", "lang", "buckets", "counts").limit(2 * sample_rows).collect()
    return [(r.lang, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in taken]


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> Model | None:
    rows = training_rows(labelled, sample_rows)
    return fit(rows, seed) if any(len(b) for _, b, _ in rows) else None


# --- prediction -------------------------------------------------------------------


def predict_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, calibrated scores, and whether each text is accepted."""
    n = len(texts)
    names, scores, accepted = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    if model is None:
        return names, scores, accepted
    sums = np.zeros((n, 2 * len(model.languages)))
    grams = np.zeros(n, np.int64)
    short = [i for i, t in enumerate(texts) if t and len(t) <= BLOCK_POINTS]
    at = 0
    while at < len(short):
        block, held = [], 0
        while at < len(short) and (not block or held + len(texts[short[at]]) <= BLOCK_POINTS):
            block.append(short[at])
            held += len(texts[short[at]])
            at += 1
        points, starts = text_points([texts[i] for i in block])
        for positions, buckets in gram_buckets(points):
            _add(model, positions, buckets, starts, np.array(block), sums, grams)
    for i, text in enumerate(texts):
        if text and len(text) > BLOCK_POINTS:
            for positions, buckets in long_text_grams(text):
                _add(model, positions, buckets, np.zeros(1, np.int64), np.array([i]), sums, grams)
    known = np.flatnonzero(grams)
    if len(known):
        means, familiar = np.split(sums[known] / grams[known, None], 2, axis=1)
        chances = model.chances(means, familiar)
        for i, k in zip(known, chances.argmax(axis=1), strict=True):
            names[i] = model.languages[k]
        scores[known] = chances.max(axis=1)
        accepted[known] = scores[known] >= model.threshold
    return names, scores, accepted


def _add(model, positions, buckets, starts, rows, sums, grams) -> None:
    """Add the n-grams' weights to the rows that they begin in."""
    if not len(positions):
        return
    # An n-gram may begin at the mark before its text, which is the text's start.
    first = np.searchsorted(positions, starts)
    full = np.flatnonzero(np.diff(np.append(first, len(positions))) > 0)
    for part, table in zip(np.split(sums, 2, axis=1), (model.weights, model.likely), strict=True):
        part[rows[full]] += np.add.reduceat(table[buckets], first[full], axis=0)
    grams[rows[full]] += np.diff(np.append(first, len(positions)))[full]


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred, score and accepted, from their text only."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ADDED]
    rows, at_text = docs.select(*[F.col(f"`{c}`") for c in kept]), kept.index("text")
    schema = StructType([*rows.schema.fields])
    schema = schema.add("lang_pred", StringType()).add("score", DoubleType()).add("accepted", BooleanType())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores, accepted = predict_texts(model, part.column(at_text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names), pa.array(scores), pa.array(accepted)],
                    names=[f.name for f in schema.fields],
                )

    return rows.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
