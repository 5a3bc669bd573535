"""Substring deduplication by paragraph MinHash banding and exact windows.

Texts are cut by content, so that a passage copied into the middle of another text falls into the same
parts however its lines are wrapped. Each place between two words has a rank: ends of lines before ends of
sentences before other places, and among those a hash of the two words before. A line end after which a
small ASCII letter goes on in the same sentence is a wrap and ranks as any other place. Places that rank
highest among the ``MIN_WORDS // 2 - 1`` on either side end a *piece*, the unit that is numbered and removed;
those that do so among ``MIN_WORDS - 1`` also end a *paragraph*. So every word of a text of ``MIN_WORDS``
words or more is in a paragraph of that length, and each two neighbouring pieces are a *window* of that length.

Each distinct paragraph has MinHash values of its five-word shingles in ``BANDS`` bands of ``ROWS``, tuned
for recall: similarity 0.8 collides with probability 1 - (1 - 0.8^2)^5 = 0.994. Colliding paragraphs are
joined and verified by exact Jaccard similarity; classes are the components of the links. Windows are
compared by their key only: they find the ends of a passage, which lie in paragraphs that differ. All
occurrences of a class or window but the first (smallest document, then place) are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.llm.near_dedup import band_hashes, span_keys, text_keys, weighted
from orevein.llm.nearlink import fetch_grams, link_classes, shared_buckets
from orevein.llm.numbering import numbered
from orevein.session import discard, load, materialize

MIN_WORDS = 10
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 5, 2
NUM_BITS, PIECE_BITS = 39, 24  # of a place: 5 * 10^11 texts, 16 million pieces of a text

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_FACTORS = words.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _highest(rank: np.ndarray, reach: int) -> np.ndarray:
    """Whether each place ranks above all of the ``reach`` before it and not below those after it."""
    out = np.ones(len(rank), bool)
    for d in range(1, reach + 1):
        out[d:] &= rank[d:] > rank[:-d]
        out[:-d] &= rank[:-d] >= rank[d:]
    return out


def pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts' words: starts and hashes; of their pieces: first words (and the number of words), text numbers, and whether a paragraph begins."""
    starts, stops = words.word_spans(raw, ends)
    hashes = words.span_hashes(raw, starts, stops)
    n = len(starts)
    bounds = np.searchsorted(starts, ends)
    if n == 0:
        return starts, hashes, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    sentence = np.zeros(n + 1, bool)
    sentence[1:] = _ENDS[raw[stops - 1]]
    breaks = np.zeros(n + 1, np.int64)
    breaks[1:n] = lines[starts[1:]] - lines[stops[:-1]]
    goes_on = np.zeros(n + 1, bool)
    goes_on[:n] = (raw[starts] >= ord("a")) & (raw[starts] <= ord("z")) & (breaks[:n] < 2)
    line = (breaks > 0) & (sentence | ~goes_on)
    before = np.append(np.uint64(0), hashes[:-1])
    before[bounds[bounds < n]] = 0  # no text depends on its neighbours
    rank = np.zeros(n + 1, np.uint64)
    rank[1:] = words.mix(hashes * _FACTORS[0] + before) >> np.uint64(3)
    rank |= np.where(line, 2, sentence).astype(np.uint64) << np.uint64(61)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    rank[edge] = np.uint64(1 << 63)
    firsts = np.flatnonzero((edge | _highest(rank, MIN_WORDS // 2 - 1))[:n])
    whole = (edge | _highest(rank, MIN_WORDS - 1))[firsts]
    return starts, hashes, np.append(firsts, n), np.searchsorted(bounds, firsts, side="right") - 1, whole


def _paragraphs(hashes: np.ndarray, firsts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First pieces, first words (and the number of words) and keys of the paragraphs; a shorter text has key 0."""
    at = np.flatnonzero(whole)
    offsets = np.append(firsts[at], firsts[-1])
    return at, offsets, np.where(np.diff(offsets) >= MIN_WORDS, text_keys(hashes, offsets), 0)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph and window: its item, its place (number of the text and of the first piece) and, for a paragraph, its number of pieces."""
    for batch in batches:
        nums = batch.column("num").to_numpy(zero_copy_only=False)
        for first, last, raw, ends in words.slices(batch.column("text")):
            _, hashes, firsts, doc, whole = pieces(raw, ends)
            at, _, item = _paragraphs(hashes, firsts, whole)
            count = np.diff(np.append(at, len(doc)))
            pair = np.flatnonzero(doc[1:] == doc[:-1])
            pair = pair[~np.isin(pair, at[count == 2])]  # those are paragraphs
            number = np.arange(len(doc)) - np.searchsorted(doc, np.arange(last - first + 1))[doc]
            if number.max(initial=0) >> PIECE_BITS:
                raise ValueError(f"a text has more than {1 << PIECE_BITS} pieces")
            some = item != 0
            piece = np.concatenate([at[some], pair])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([item[some], span_keys(hashes, firsts[pair], firsts[pair + 2])]).astype(np.int64)),
                    pa.array((nums[first:last][doc[piece]] << PIECE_BITS) + number[piece]),
                    pa.array(np.concatenate([count[some], np.zeros(len(pair))]).astype(np.int32)),
                ],
                names=["item", "place", "pieces"],
            )


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's number of words by piece."""
    for batch in batches:
        for first, last, raw, ends in words.slices(batch.column("text")):
            _, _, firsts, doc, _ = pieces(raw, ends)
            bounds = np.searchsorted(doc, np.arange(last - first + 1))
            own = [batch.column(c).slice(first, last - first) for c in ("doc_id", "num")]
            yield pa.RecordBatch.from_arrays([*own, words.list_array(np.diff(firsts).astype(np.int32), bounds, pa.int32())], names=["doc_id", "num", "sizes"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent = words.Recent()
    for batch in batches:
        for _, _, raw, ends in words.slices(batch.column("text")):
            _, hashes, firsts, _, whole = pieces(raw, ends)
            _, bounds, item = _paragraphs(hashes, firsts, whole)
            shingles, offsets = words.shingles(hashes, bounds, SHINGLE)
            item, once = np.unique(item, return_index=True)
            item, once = item[item != 0], once[item != 0]
            fresh = recent.fresh(item)
            item, once = item[fresh], once[fresh]
            if not len(item):
                continue
            low = [np.minimum.reduceat(shingles * f, offsets[:-1]) for f in _FACTORS]
            buckets = band_hashes(np.stack(low, axis=1)[once], BANDS, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel().astype(np.int64)), pa.array(np.repeat(item, BANDS).astype(np.int64))], names=["bucket", "item"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = [set(w) for w in batch.column("wanted").to_pylist()]
        for start, _, raw, ends in words.slices(batch.column("text")):
            _, hashes, firsts, of_piece, whole = pieces(raw, ends)
            at, offsets, item = _paragraphs(hashes, firsts, whole)
            doc, item = of_piece[at], item.astype(np.int64)
            of, h, _ = weighted(*words.shingles(hashes, offsets, SHINGLE))
            bounds = np.searchsorted(of, np.arange(len(item) + 1))
            every = pa.RecordBatch.from_arrays([pa.array(item), words.list_array(h.astype(np.int64), bounds, pa.int64())], names=["item", "grams"])
            yield every.filter(pa.array([k in asked[start + d] for k, d in zip(item.tolist(), doc.tolist(), strict=True)], pa.bool_()))


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, n_paragraphs, n_repeated, n_removed, n_words, removed_words, removed``.

    Counts and numbers are those of pieces. ``n_repeated`` counts the ones in paragraphs and windows that occur
    elsewhere too, the first occurrences included; ``removed`` holds the numbers (from 0) of those to be
    removed. Null texts count as empty and have no pieces; rows that repeat an identifier are texts of their
    own, in the order of their texts, and null identifiers come last. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = numbered(docs, NUM_BITS)
    parts = materialize(rows.select("num", "text").mapInArrow(_occurrences, "item long, place long, pieces int"), "parts")
    shared = shared_buckets(rows.select("text").mapInArrow(_buckets, "bucket long, item long"))
    number = lambda place: F.col(place).bitwiseAND(F.lit((1 << PIECE_BITS) - 1)).cast("int")
    num = lambda place: F.shiftright(place, PIECE_BITS)
    owners = parts.filter("pieces > 0").join(shared.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.min(num("place")).alias("num"))
    grams = fetch_grams(rows, owners, _grams, "num")
    classes = link_classes(shared, grams, similarity)
    discard(shared, grams)
    contents = parts.groupBy("item").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    several = classes.unionByName(classes.select(F.col("component").alias("item"), "component").distinct())
    classed = contents.join(several, "item", "left").filter("n > 1 or component is not null")
    classed = materialize(classed.select("item", "first", "n", F.coalesce("component", "item").alias("class")), "contents")
    totals = classed.groupBy("class").agg(F.min("first").alias("first"))
    discard(classes)
    repeated = materialize(classed.select("item", "class").join(totals, "class").select("item", "first"), "repeated")
    # windows that overlap the first occurrence of what they repeat stay as it does
    gone = (num("place") != num("first")) | (number("place") > number("first") + F.when(F.col("pieces") == 0, 1).otherwise(0))
    known = parts.join(repeated, "item").select(num("place").alias("num"), F.struct(number("place").alias("at"), F.when(F.col("pieces") == 0, 2).otherwise(F.col("pieces")).alias("pieces"), gone.alias("gone")).alias("part"))
    found = known.groupBy("num").agg(F.collect_list("part").alias("parts"))
    numbers = lambda parts: F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["at"], p["at"] + p["pieces"] - 1)))))
    out = rows.mapInArrow(_sizes, "doc_id long, num long, sizes array<int>").join(found, "num", "left")
    none = F.array().cast("array<int>")
    out = out.withColumn("known", F.coalesce(numbers(F.col("parts")), none)).withColumn("removed", F.coalesce(numbers(F.filter("parts", lambda p: p["gone"])), none))
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id",
        F.size("sizes").cast("long").alias("n_paragraphs"),
        F.size("known").cast("long").alias("n_repeated"),
        F.size("removed").cast("long").alias("n_removed"),
        total(F.col("sizes")).alias("n_words"),
        total(F.transform("removed", lambda k: F.get("sizes", k))).alias("removed_words"),
        "removed",
    )


def without_paragraphs(rows: DataFrame, text_col: str = "text", removed_col: str = "removed", out_col: str = "text") -> DataFrame:
    """``rows`` with ``out_col``, the text less the pieces numbered in ``removed_col`` (each from its first word up to the next piece)."""

    @F.arrow_udf("string")
    def strip(texts: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if gone and len(raw):
                starts, _, firsts, _, _ = pieces(raw, np.array([0, len(raw)]))
                begins = np.append(starts, len(raw))[firsts]
                keep = np.ones(len(raw), bool)
                for k in gone:
                    keep[begins[k] : begins[k + 1]] = False
                text = raw[keep].tobytes().decode()
            out.append(text)
        return pa.array(out, pa.string())

    return rows.withColumn(out_col, strip(F.col(text_col), F.col(removed_col)))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(load(spark, sf_dir, "documents"))


QUERIES = {"op2_paragraph_dedup": op2_paragraph_dedup}
SQL: dict[str, str] = {}
