"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 5 bytes of a text's lower-cased words, word bounds included,
hashed to 2**FEATURE_BITS columns. A column's value is the log ratio of its frequencies in toxic and clean
texts, drawn to 0 by SMOOTHING texts, and 0 for columns that chance explains; a logistic regression
weighs these values. It is fitted on at most SAMPLE_PER_CLASS labelled texts of either class (those with the
least hash of doc_id), whose features executors compute; every document is then scored in one pass with the
weights, whose size is fixed.

Cases: a null or empty text has no feature and gets the score of the intercept; rows without a label, or with a
null doc_id, are scored but not learned from; a label that repeats for a doc_id counts each time; without
labels of both classes the score is the share of toxic ones (0 without any); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import LOWER, mix, plain, slices, small_batches, span_hashes, spans_of, text_buffers

FEATURE_BITS = 18
#: Bytes of text whose features are made together.
SLICE_BYTES = 1 << 19
SIZES = (3, 4, 5)
#: Bound of the sample: labelled texts of each class.
SAMPLE_PER_CLASS = 3000
SMOOTHING = 5.0
#: A column counts if its toxic texts are more than so many standard deviations from the expected number.
DEVIATIONS = 5.0
PENALTY = 1e-3
#: Weight of the toxic class as a whole in the loss.
TOXIC_WEIGHT = 0.25
STEPS = 150

#: Letters and digits in ASCII, and all bytes of other characters, belong to words.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _grams(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and columns of the n-grams of lower-cased bytes, spaces around each word."""
    word = wide != 0x20
    n, symbols = len(wide), wide.astype(np.uint64)
    places, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        inner = np.ones(m, bool)
        for k in range(1, size - 1):
            inner &= word[k : m + k]
        at = np.flatnonzero(inner)
        key = np.zeros(len(at), np.uint64)
        for k in range(size):
            key = (key << np.uint64(8)) | symbols[at + k]
        places.append(at)
        columns.append((mix(key + (np.uint64(size) << np.uint64(56))) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    return np.concatenate(places), np.concatenate(columns)


def _distinct(owners: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's different columns, by owner."""
    both = np.unique((owners << FEATURE_BITS) | columns)
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def features(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct columns of each row, sorted."""
    rows = len(offsets) - 1
    wide = np.full(len(raw) + rows + 1, 0x20, np.uint8)  # a space before each row and at the end
    row = np.repeat(np.arange(rows), np.diff(offsets))
    wide[np.arange(len(raw)) + row + 1] = LOWER[raw]
    wide[~_WORD[wide]] = 0x20
    at, columns = _grams(wide)
    owners, columns = _distinct(np.searchsorted(offsets + np.arange(rows + 1), at, side="right") - 1, columns)
    cuts = np.searchsorted(owners, np.arange(rows + 1))
    columns = columns.astype(np.int32)
    return [columns[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _feature_lists(column: pa.Array) -> Iterator[np.ndarray]:
    raw, offsets = text_buffers(column)
    for x, y in slices(offsets, SLICE_BYTES):
        yield from features(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])


class Model:
    """weights (a float for each column) and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row of a slice.

        n-grams lie within words, so each different word of the slice has its columns made once, and only those of some weight
        go on to the rows that hold the word.
        """
        raw = LOWER[raw]
        starts, ends, rows = spans_of(~_WORD, raw, offsets)
        _, first, word = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        sizes = ends[first] - starts[first]
        begins = np.cumsum(sizes + 1) - sizes - 1
        wide = np.full(int(sizes.sum()) + len(sizes) + 1, 0x20, np.uint8)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide[np.repeat(begins, sizes) + 1 + at] = raw[np.repeat(starts[first], sizes) + at]
        place, columns = _grams(wide)
        heavy = self.weights[columns] != 0
        owners, columns = _distinct(np.searchsorted(begins, place[heavy], side="right") - 1, columns[heavy])
        cuts = np.searchsorted(owners, np.arange(len(sizes) + 1))
        many = np.diff(cuts)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
        held = many[word] > 0
        pairs = np.unique(row[held] * max(1, len(sizes)) + word[held])
        row, word = np.divmod(pairs, max(1, len(sizes)))
        count = many[word]
        at = np.repeat(cuts[word], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row, columns = _distinct(np.repeat(row, count), columns[at])
        z = self.intercept + np.bincount(row, weights=self.weights[columns], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def scores_of(self, column: pa.Array) -> np.ndarray:
        raw, offsets = text_buffers(column)
        return np.concatenate([np.zeros(0), *(self.scores(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]) for x, y in slices(offsets, SLICE_BYTES))])


def fit(examples: list[tuple[np.ndarray, int]]) -> Model:
    """From the columns and the label (0 or 1) of each text."""
    size = 1 << FEATURE_BITS
    y = np.array([label for _, label in examples], np.float64)
    toxic, clean = y.sum(), len(y) - y.sum()
    if not toxic or not clean:
        share = y.mean() if len(y) else 0.0
        return Model(np.zeros(size), np.log(share + 1e-9) - np.log(1 - share + 1e-9))
    columns = np.concatenate([c for c, _ in examples])
    row = np.repeat(np.arange(len(y)), [len(c) for c, _ in examples])
    in_toxic = np.bincount(columns, weights=y[row], minlength=size)
    in_clean = np.bincount(columns, minlength=size) - in_toxic
    texts, pi = in_toxic + in_clean, toxic / len(y)
    # log ratio of the class shares among a column's texts, SMOOTHING texts of the common shares added
    ratio = np.log((in_toxic + SMOOTHING * pi) / ((texts + SMOOTHING) * pi)) - np.log((in_clean + SMOOTHING * (1 - pi)) / ((texts + SMOOTHING) * (1 - pi)))
    ratio[(in_toxic - texts * pi) ** 2 < DEVIATIONS**2 * texts * pi * (1 - pi)] = 0
    used = ratio[columns] != 0
    columns, row = columns[used], row[used]
    values = ratio[columns]
    weights = np.zeros(size)
    sample = np.where(y == 1, TOXIC_WEIGHT / toxic, (1 - TOXIC_WEIGHT) / clean)
    intercept = 0.0
    m, v = np.zeros(size), np.zeros(size)
    m0 = v0 = 0.0
    for step in range(1, STEPS + 1):  # full gradients, Adam
        z = np.bincount(row, weights=values * weights[columns], minlength=len(y)) + intercept
        error = sample * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        gradient = np.bincount(columns, weights=values * error[row], minlength=size) + PENALTY * weights
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        g0 = error.sum()
        m0, v0 = 0.9 * m0 + 0.1 * g0, 0.999 * v0 + 0.001 * g0**2
        rate = 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        weights -= rate * m / (np.sqrt(v) + 1e-8)
        intercept -= rate * m0 / (np.sqrt(v0) + 1e-8)
    return Model(weights * ratio, intercept)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """labels: doc_id and toxic."""
    small_batches(docs.sparkSession)
    texts = plain(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(~held_out())
    parts = [marks.filter(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = texts.join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id").select("toxic", "text")  # 2 * per_class rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("toxic"), pa.array([c.tobytes() for c in _feature_lists(b.column("text"))], pa.binary())], names=["toxic", "columns"])

    return fit([(np.frombuffer(r["columns"], np.int32), r["toxic"]) for r in chosen.mapInArrow(run, "toxic int, columns binary").toLocalIterator()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**FEATURE_BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.scores_of(b.column("text")), pa.float64())], names=["doc_id", "score"])

    scored = plain(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5, with all their columns (whose names must differ), in one pass."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores_of(b.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    return score(docs, train(docs, labels, per_class))
