"""Language identification by multinomial naive Bayes over hashed character n-grams.

Characters other than letters count as spaces, letters in lower case; each text stands between two
spaces. Bigrams and trigrams are hashed into ``BUCKETS`` counters. Training is one pass over all
labelled texts outside the held-out fold: each task sums its counts per language, Spark adds them up.
The log-probability matrix (languages x ``BUCKETS`` floats, whatever the corpus holds; at most
``MAX_LANGS`` languages) is broadcast, and batches are scored in numpy as sparse sums over its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.session import discard, load, materialize

BUCKETS = 1 << 16
ORDERS = (2, 3)
SMOOTHING = 0.5
MAX_LANGS = 256
AT_ONCE = 16
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (each between two spaces, letters only) and their offsets."""
    padded = [f" {t.lower()} " if t else "  " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[~_letters()[points]] = 32
    return points, np.concatenate([[0], np.cumsum([len(t) for t in padded])]).astype(np.int64)


def _grams(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each ``n``-gram and whether it counts (holds a letter)."""
    m = len(points) - n + 1
    h, real = np.full(m, n, np.uint32), np.zeros(m, bool)
    for k in range(n):
        part = points[k : k + m]
        h = h * np.uint32(0x9E3779B1) + part
        real |= part != 32
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(16)).astype(np.int64) % BUCKETS, real


def _text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, _, _ in words.slices(column):
        points, offsets = _points(column[first:last].to_pylist())
        yield first, last, points, offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, last, points, offsets in _text_slices(batch.column("text")):
            of_doc = np.repeat(np.arange(last - first), np.diff(offsets))
            own = langs[first:last]
            for lang in set(own):
                total = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += int((own == lang).sum())
                mine = (own == lang)[of_doc]
                for n in ORDERS:
                    bucket, real = _grams(points, n)
                    ends = np.arange(n - 1, len(points))
                    use = real & mine[: len(bucket)] & (of_doc[: len(bucket)] == of_doc[ends])
                    total[:BUCKETS] += np.bincount(bucket[use], minlength=BUCKETS)
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(used)), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["lang", "bucket", "n"])


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """``crc32`` of the identifier as text (null as the empty text) modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log priors and the log-probability matrix, from rows with a language and a text."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = materialize(rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r.lang for r in counted.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the matrix would not fit into a broadcast")
    counts = np.zeros((len(langs), BUCKETS + 1))
    for k in range(0, len(langs), AT_ONCE):  # at most AT_ONCE x BUCKETS rows on the driver
        found = counted.filter(F.col("lang").isin(langs[k : k + AT_ONCE])).toPandas()
        counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    discard(counted)
    docs_per, grams = counts[:, BUCKETS], counts[:, :BUCKETS]
    prior = np.log((docs_per + 1) / (docs_per.sum() + max(1, len(langs))))
    matrix = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return langs, prior, matrix.astype(np.float32)


def _predict(texts: pa.Array, langs: list[str], prior: np.ndarray, matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(texts))
    for first, last, points, offsets in _text_slices(texts):
        totals = np.tile(prior, (last - first, 1)) if langs else np.zeros((last - first, 1))
        for n in ORDERS:
            bucket, real = _grams(points, n)
            of_doc = np.repeat(np.arange(last - first), np.diff(offsets))
            crosses = ~real | (of_doc[: len(bucket)] != of_doc[n - 1 :])
            for k in range(len(langs)):
                each = matrix[k][bucket].astype(np.float64)
                each[crosses] = 0
                totals[:, k] += words.sums(each, np.minimum(offsets, len(each)))
        letters = np.concatenate([[0], np.cumsum(points != 32)])
        known = (letters[offsets[1:]] > letters[offsets[:-1]]) & bool(langs)
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        names += [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        scores[first:last] = np.where(known, share, 0.0)
    return names, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior of that language) instead of any such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = _predict(texts, *shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("__p", predict(F.col("text"))).select("*", "__p.lang_pred", "__p.score").drop("__p")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no row can be
    learned from (an empty or unlabelled table). Rows with a null language are predicted but not learned
    from; repeated rows count each; ties go to the language first in order; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", (fold() == HELD_OUT).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))
    return identify(rows.select("doc_id", "held_out", "text"), model).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
