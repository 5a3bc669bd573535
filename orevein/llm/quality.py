"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text is a row of tokens: runs of letters, of digits and of other signs. Each token has a surface
form and a shape (its kind, case and length; a token equal to the one before it has the shape of a
repeat). Unigrams and bigrams of either row are hashed into ``BUCKETS`` features whose values are
their relative frequencies, so a score is the sparse dot product of those and the weights.
The model is fitted in one task on a bounded sample of labelled rows (``TRAIN_DOCS``, those with the
smallest hashes of their identifiers); every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.session import load

BUCKETS = 1 << 18
TRAIN_DOCS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-5
SCALE = 10.0
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3

_SPACE_KIND, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE_KIND
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of the texts and each text's offsets into them."""
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    begins = np.ones(len(raw), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], len(raw))
    token = kind[starts] != _SPACE_KIND
    starts, stops = starts[token], stops[token]
    surface = words.span_hashes(raw, starts, stops, lower=False)
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    capitals, length = upper[stops] - upper[starts], stops - starts
    case = np.where(capitals == 0, 0, np.where(capitals == length, 1, np.where((capitals == 1) & (_UPPER[raw[starts]] == 1), 2, 3)))
    shape = (kind[starts].astype(np.int64) * 4 + case) * 16 + np.minimum(length, 15)
    if len(surface) > 1:
        shape[1:][surface[1:] == surface[:-1]] = 4096
    shape = words.mix(shape.astype(np.uint64) + np.uint64(1 << 40))
    bounds = np.searchsorted(starts, ends)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    own = doc[1:] == doc[:-1]
    parts = [surface, shape, words.chain(surface, 2)[own], words.chain(shape, 2)[own]]
    of = np.concatenate([doc, doc, doc[1:][own], doc[1:][own]])
    order = np.argsort(of, kind="stable")
    numbers = (np.concatenate(parts) >> np.uint64(46)).astype(np.int64)[order]
    return numbers, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(counts)))]).astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, ends in words.slices(batch.column("text")):
            numbers, offsets = features(raw, ends)
            index, value, sizes = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                used, times = np.unique(numbers[a:b], return_counts=True)
                index.append(used)
                value.append(times * (SCALE / max(1, b - a)))
                sizes.append(len(used))
            at = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("turn").slice(first, last - first),
                    batch.column("label").slice(first, last - first),
                    words.list_array(np.concatenate(index).astype(np.int32), at, pa.int32()),
                    words.list_array(np.concatenate(value).astype(np.float32), at, pa.float32()),
                ],
                names=["turn", "label", "index", "value"],
            )


def fit_ftrl(examples: list[tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights (the last is the bias) after ``EPOCHS`` passes of follow-the-regularised-leader updates."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, index, value in examples:
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
            n[index] += g * g
    return weights(np.arange(BUCKETS + 1))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches:
        for label, index, value in zip(batch.column("label").to_pylist(), batch.column("index"), batch.column("value"), strict=True):
            i, v = index.values.to_numpy(zero_copy_only=False), value.values.to_numpy(zero_copy_only=False)
            examples.append((float(label), np.append(i, np.int32(BUCKETS)), np.append(v, np.float32(1))))
    w = fit_ftrl(examples)
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(w[used])], names=["index", "weight"])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights learned from at most ``train_docs`` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    sample = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(train_docs)
    # one text a document, should its number be repeated: the sample bounds what the fitting task holds
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.groupBy("doc_id", "turn", "label").agg(F.min("text").alias("text"))
    examples = rows.select("turn", "label", "text").mapInArrow(_examples, "turn long, label int, index array<int>, value array<float>")
    fitted = examples.repartition(1).sortWithinPartitions("turn").mapInArrow(_fit, "index int, weight double").toPandas()
    out = np.zeros(BUCKETS + 1)
    out[fitted["index"].to_numpy(int)] = fitted["weight"].to_numpy(float)
    return out


def with_score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, out = shared.value, np.zeros(len(texts))
        for first, last, raw, ends in words.slices(texts):
            numbers, offsets = features(raw, ends)
            out[first:last] = w[BUCKETS] + SCALE * words.sums(w[numbers], offsets) / np.maximum(1, np.diff(offsets))
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn("score", score(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null texts count as empty and score the bias alone. Labels that are null or repeated for a document
    are left out or averaged; of texts that repeat a labelled number the first in order is learned from; without any label every score is 0.5. Repeated rows are scored each, an
    empty table gives an empty result and other columns are ignored.
    """
    weights = train(docs, labels)
    scored = with_score(docs.select("doc_id", held_out().alias("held_out"), "text"), weights)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are accepted, with their own columns."""
    columns = docs.columns
    text = docs.select(F.struct(*columns).alias("row"), "text")
    return with_score(text, train(docs, labels)).filter(F.col("score") >= ACCEPT).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(*load(spark, sf_dir, "documents", "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
