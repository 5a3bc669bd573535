"""Near-duplicate documents by ProbMinHash.

A document is the weighted set of its five-word shingles, the weight being how often each occurs. Every
shingle is a Poisson process whose rate is its weight; its arrivals fall into random registers, and a
register keeps the shingle that arrives first. A document's processes stop as soon as their next
arrivals come after the last register's (early termination). Two documents agree in a register with
the probability Jaccard similarity of their weights, which for sets is the Jaccard similarity.
``BANDS`` bands of ``ROWS`` registers give the buckets: a pair of similarity 0.8 shares one with
probability 1 - (1 - 0.8^4)^16 = 0.9998. Links are those of sets, so a text that repeats a shingle is also
banded with all weights 1, which gives each pair to be linked that probability however its repeats differ.
Colliding documents are verified by the exact Jaccard similarity of their shingle sets, all pairs of
those that are not in one class yet, and classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.llm.exact_dedup import keep_rows
from orevein.llm.nearlink import fetch_grams, link_classes, shared_buckets
from orevein.session import discard, load, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS


def weighted(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, count; ordered by both."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingles, doc))
    doc, h = doc[order], shingles[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """``n_docs x m`` registers; those of a text without shingles are 0."""
    first = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    sizes = np.bincount(doc, minlength=n_docs)
    single = sizes[doc] == 1  # all arrivals are of the one shingle
    for d, x in zip(doc[single], h[single], strict=True):
        held[d * m : (d + 1) * m] = x
    doc, h, rate = doc[~single], h[~single], weight[~single].astype(float)
    t, turn = np.zeros(len(h)), 0
    while len(h):
        turn += 1
        step = words.mix(h + np.uint64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        t = t - np.log(((step >> np.uint64(11)).astype(float) + 0.5) / 2**53) / rate
        slot = doc * m + (words.mix(step) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = t == first[slot]
        held[slot[won]] = h[won]
        last = first.reshape(n_docs, m).max(axis=1) if turn < 4 or turn % 8 == 0 else last
        go = t < last[doc]
        doc, h, rate, t = doc[go], h[go], rate[go], t[go]
    return held.reshape(n_docs, m)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each text and band."""
    out = np.zeros((len(registers), bands), np.uint64)
    for r in range(rows):
        out = words.mix(out + registers[:, r::rows][:, :bands])
    return words.mix(out + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_keys(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of words ``[start, stop)``; 0 for one without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(len(starts), np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * words.powers(n), dtype=np.uint64)])
    key = (total[stops] - total[starts]) * words.powers(n + 1, inverse=True)[starts]
    return np.where(stops > starts, words.mix(key + (stops - starts).astype(np.uint64)), 0)


def text_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's row of words; 0 for a text without words."""
    return span_keys(hashes, offsets[:-1], offsets[1:])


def _prepared(batch: pa.RecordBatch):
    for first, last, raw, ends in words.slices(batch.column("text")):
        hashes, offsets = words.words(raw, ends)
        yield first, last, hashes, offsets, text_keys(hashes, offsets)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, _, _, keys in _prepared(batch):
            own = [batch.column(name).slice(first, last - first) for name in ("doc_id", "digest")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys.astype(np.int64))], names=["doc_id", "digest", "item"])


def _registers(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers and the numbers of their texts: one row a text, and one of unit weights for those that repeat a shingle."""
    doc, h, weight = weighted(*words.shingles(hashes, offsets, SHINGLE))
    n = len(offsets) - 1
    repeats = np.bincount(doc[weight > 1], minlength=n) > 0
    again = repeats[doc]
    number, texts = np.cumsum(repeats) - 1, np.flatnonzero(repeats)
    unit = prob_minhash(number[doc[again]], h[again], np.ones(np.count_nonzero(again), np.int64), len(texts))
    return np.concatenate([prob_minhash(doc, h, weight, n), unit]), np.concatenate([np.arange(n), texts])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent = words.Recent()
    for batch in batches:
        for _, _, hashes, offsets, every in _prepared(batch):
            registers, text = _registers(hashes, offsets)
            keys = every[text]
            distinct = np.unique(every[every != 0])
            keep = np.isin(keys, distinct[recent.fresh(distinct)])
            buckets = band_hashes(registers[keep], BANDS, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel().astype(np.int64)), pa.array(np.repeat(keys[keep], BANDS).astype(np.int64))], names=["bucket", "item"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, offsets, keys in _prepared(batch):
            doc, h, _ = weighted(*words.shingles(hashes, offsets, SHINGLE))
            bounds = np.searchsorted(doc, np.arange(last - first + 1))
            every = pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), words.list_array(h.astype(np.int64), bounds, pa.int64())], names=["item", "grams"])
            asked = batch.column("wanted").slice(first, last - first).to_pylist()
            yield every.filter(pa.array([k in w for k, w in zip(every.column("item").to_pylist(), asked, strict=True)], pa.bool_()))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept``.

    ``keep_id`` is the smallest ``doc_id`` of the row's class: the documents that links of similarity
    ``similarity`` or more join, directly or through others. Texts with the same words (ASCII case and white
    space aside) are copies. Null texts count as empty; texts without a word link with nothing and are each
    their own class. Texts of fewer than five words are one shingle. Null identifiers come last. Of rows that
    repeat the smallest identifier one is kept. Other columns are ignored; an empty table gives an empty result.
    Distinct texts are told apart by 64 bits of their words: two of ``n`` are taken for one with ``n^2 / 2^65``.
    """
    return _decided(docs, similarity, F.lit("")).drop("digest")


def _decided(docs: DataFrame, similarity: float, digest: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    keys = materialize(rows.mapInArrow(_keys, "doc_id long, digest string, item long").withColumn("row", F.monotonically_increasing_id()), "keys")
    shared = shared_buckets(rows.select("text").mapInArrow(_buckets, "bucket long, item long"))
    items = shared.select("item").distinct()
    owners = keys.join(items, "item", "left_semi").groupBy("item").agg(F.min("doc_id").alias("doc_id"))
    grams = fetch_grams(rows, owners, _grams)
    classes = link_classes(shared, grams, similarity)
    discard(shared, grams)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    worded = keys.filter("item <> 0")
    contents = worded.groupBy("item").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    grouped = contents.join(classes, "item", "left").withColumn("class", F.coalesce("component", "item"))
    totals = grouped.groupBy("class").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size")).filter("group_size > 1")
    # only items in classes of several rows are joined back: the others are their own class
    decided = materialize(grouped.select("item", "class").join(totals, "class").select("item", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "classes")
    joined = worded.join(decided, "item", "left")
    found = joined.select("doc_id", "digest", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"))
    wordless = keys.filter("item = 0").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return found.unionByName(wordless)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were; a row is known by its ``doc_id`` and its text."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    return keep_rows(docs, _decided(docs, SIMILARITY, digest).select("doc_id", "digest", "kept"), digest)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(load(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
SQL: dict[str, str] = {}
