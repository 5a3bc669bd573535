"""Exact substring dedup: every byte covered by a ``LENGTH``-byte string that also starts earlier goes.

Plan. A string of ``LENGTH`` bytes has a minimiser: the ``K``-byte gram of least hash in it (the leftmost
of equals). Equal strings have equal minimisers, so each text is cut into pieces, the runs of string
starts that share one minimiser, and only pieces with the same minimiser can hold equal strings.

1. Minimisers that occur once are dropped (an aggregate with map-side combining).
2. Equal pieces are folded: of all occurrences of a piece but the first, every string starts earlier.
3. Different pieces of one minimiser are compared by column-wise construction: the collection's
   Burrows-Wheeler transform and common prefixes grow by one symbol of every piece a round, right to left,
   each round reading the two files of the round before in sequence and writing the next. Each string holds
   the whole minimiser, so that is one symbol, ``MARK``, and a string has ``FOLDED`` symbols. Intervals of
   common prefixes of that many or more, by the bytes of the minimiser, are groups of equal strings; the one
   that starts first stays.
   Up to ``HOT`` different pieces of a minimiser (2 MB, about two seconds) are one task's. Minimisers with
   more (the edges of a passage that very many documents share) are split by string: their strings are
   grouped by a hash of 128 bits, combined before the shuffle.
4. Each document gets its intervals, and what they leave is hashed.

Building one transform over whole documents this way would take as many rounds as the longest has bytes,
each passing over all that was inserted: folded pieces bound the rounds by ``2 * FOLDED - 1``.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.llm.numbering import numbered
from orevein.session import discard, load, materialize

LENGTH = 100
K = 48
HOT = 20_000
COLLECTION = 1 << 17
CHUNK = 1 << 19
ROWS = 1024
MARK = 254  # no byte of UTF-8
FOLDED = LENGTH - K + 1
_WINDOW = LENGTH - K + 1
_PLACE = np.uint64((1 << 21) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbouring entries."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def pieces(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first string start (in ``raw``), number of starts and minimiser hash of each piece."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(n - K + 1)
    grams = words.span_hashes(raw, at, at + K, lower=False)
    least = _sliding_min((grams & ~_PLACE) | at.astype(np.uint64), _WINDOW)
    place = (least & _PLACE).astype(np.int64)
    starts = words.ragged(ends[:-1], np.maximum(np.diff(ends) - LENGTH + 1, 0))
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    own = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    begin = starts[first]
    return np.searchsorted(ends, begin, side="right") - 1, begin, np.diff(np.append(first, len(starts))), grams[own[first]]


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``text number, offset in the text, bytes, ends`` of chunks of about ``CHUNK`` bytes; parts of a long text overlap by ``LENGTH - 1``."""
    for first, last, raw, ends in words.slices(texts, CHUNK):
        if last - first > 1 or len(raw) <= 2 * CHUNK:
            yield np.arange(first, last), np.zeros(last - first, np.int64), raw, ends
            continue
        for low in range(0, len(raw) - LENGTH + 1, CHUNK):
            part = raw[low : low + CHUNK + LENGTH - 1]
            yield np.array([first]), np.array([low]), part, np.array([0, len(part)])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, ends in _chunks(batch.column("text")):
            key, n = np.unique(pieces(raw, ends)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["key", "n"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, shift, raw, ends in _chunks(batch.column("text")):
            of, begin, count, key = pieces(raw, ends)
            content = words.span_hashes(raw, begin, begin + count + LENGTH - 1, lower=False) ^ words.mix(count.astype(np.uint64))
            at = begin - ends[of] + shift[of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int64)), pa.array(content.astype(np.int64)), batch.column("num").take(pa.array(number[of])), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["key", "content", "num", "at", "count"],
            )


def _flat(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets of the lists (null: empty), and the named fields of all their entries."""
    offsets = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)))
    entries = lists.flatten()
    return offsets, *(entries.field(name).to_numpy().astype(np.int64) for name in names)


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each text."""
    for batch in batches:
        offsets, key, at, count = _flat(batch.column("wanted"), "key", "at", "count")
        of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        raw, ends = words.buffers(batch.column("text"))
        for low in range(0, len(of), ROWS):
            part = slice(low, low + ROWS)
            size = count[part] + LENGTH - 1
            cut = raw[words.ragged(ends[of[part]] + at[part], size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[part]), batch.column("num").take(pa.array(of[part])), pa.array(at[part].astype(np.int32)), _binary(cut, np.append(0, np.cumsum(size)))],
                names=["key", "num", "at", "bytes"],
            )


class _Column:
    """A pair of files of bytes: each round reads one in sequence and writes the other, which then takes its place."""

    def __init__(self, folder: str, name: str):
        self.old, self.new = (open(os.path.join(folder, f"{name}{i}"), "w+b", buffering=0) for i in range(2))
        self.n = 0

    def read(self) -> np.ndarray:
        self.old.seek(0)
        return np.frombuffer(self.old.read(self.n), np.uint8)

    def write(self, values: np.ndarray) -> None:
        self.new.seek(0)
        rest = memoryview(np.ascontiguousarray(values, np.uint8))
        while len(rest):
            rest = rest[self.new.write(rest) :]
        self.old, self.new, self.n = self.new, self.old, len(values)

    def close(self) -> None:
        self.old.close()
        self.new.close()


def _merged(old: np.ndarray, at: np.ndarray, new: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = np.empty(len(old) + len(new), old.dtype)
    out[at] = new
    out[rest] = old
    return out


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``values[low:high]`` for each pair; ``low < high <= len(values)``."""
    if not len(low):
        return np.zeros(0, values.dtype)
    order = np.argsort(low)  # in sequence, so that what lies between two ranges is short
    padded = np.append(values, values[-1:])
    out = np.empty(len(low), values.dtype)
    out[order] = np.minimum.reduceat(padded, np.column_stack([low[order], high[order]]).ravel())[::2]
    return out


def column_wise(raw: np.ndarray, ends: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Transform (0 for an end, else a byte + 1) and common prefixes of the collection ``raw[ends[i]:ends[i + 1]]``.

    Both fit into bytes: UTF-8 has no byte 255, and no string may be longer than 254.

    In round ``j`` each string of at least ``j`` bytes inserts its suffix of that length. Its place follows from how
    often its symbol occurs in the transform before the place of the suffix one shorter; its common prefixes with
    its neighbours are one more than the least common prefix up to the next occurrence of the symbol either way.
    """
    m, length = len(ends) - 1, np.diff(ends)
    if length.max(initial=0) > 254:
        raise ValueError("strings of the collection are limited to 254 bytes")
    transform, prefixes = _Column(folder, "transform"), _Column(folder, "prefixes")
    code = lambda i, j: np.where(length[i] >= j, raw[np.maximum(ends[1:][i] - j, 0)] + np.uint8(1), 0).astype(np.uint8)
    transform.write(code(np.arange(m), 1))
    prefixes.write(np.zeros(m, np.uint8))
    active, place = np.arange(m), np.arange(m)
    for j in range(1, int(length.max(initial=0)) + 1):
        going = length[active] >= j
        active, place = active[going], place[going]
        bwt, lcp = transform.read(), prefixes.read()
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        whole = int(np.count_nonzero(bwt == 0))
        k, symbol = rank[place], bwt[place]
        before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(bwt) - 1)]
        has_before, has_after = (k > 0) & (bwt[before] == symbol), (k + 1 < len(bwt)) & (bwt[after] == symbol)
        up, down = np.zeros(len(k), np.uint8), np.zeros(len(k), np.uint8)
        up[has_before] = 1 + _range_min(lcp, before[has_before] + 1, place[has_before] + 1)
        down[has_after] = 1 + _range_min(lcp, place[has_after] + 1, after[has_after] + 1)
        at = m + k - whole
        rest = np.ones(len(bwt) + len(at), bool)
        rest[at] = False
        transform.write(_merged(bwt, at, code(active, j + 1), rest))
        lcp = _merged(lcp, at, up, rest)
        follows = at + 1 < len(lcp)
        lcp[at[follows] + 1] = down[follows]
        prefixes.write(lcp)
        place = at
    out = transform.read(), prefixes.read()
    transform.close()
    prefixes.close()
    return out


def repeated_starts(raw: np.ndarray, ends: np.ndarray, num: np.ndarray, at: np.ndarray, length: int = LENGTH, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of the strings of ``length`` symbols in the collection that start earlier in it too; string ``i`` stands at ``at[i]`` of text ``num[i]``.

    Strings of members of different ``kind`` count as different.
    """
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = column_wise(raw, ends, folder)
    m, sizes = len(ends) - 1, np.diff(ends)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt)) + m - int(np.count_nonzero(bwt == 0))
    active, place, spots, owners, offsets = np.arange(m), np.arange(m), [], [], []
    for j in range(1, int(sizes.max(initial=0)) + 1):
        going = sizes[active] >= j
        active, place = active[going], step[place[going]]
        if j >= length:
            spots.append(place)
            owners.append(active)
            offsets.append(sizes[active] - j)
    if not spots:
        return num[:0], at[:0]
    spot, owner, offset = map(np.concatenate, (spots, owners, offsets))
    in_order = np.argsort(spot)
    new = lcp[spot[in_order]] < length
    several = ~(new & np.append(new[1:], True))
    group, in_order = np.cumsum(new)[several], in_order[several]
    owner = owner[in_order]
    text, start, kind = num[owner], at[owner] + offset[in_order], np.zeros(len(owner), np.int64) if kind is None else kind[owner]
    by = np.lexsort((start, text, kind, group))
    group, kind = group[by], kind[by]
    later = np.zeros(len(by), bool)
    later[1:] = (group[1:] == group[:-1]) & (kind[1:] == kind[:-1])
    return text[by][later], start[by][later]


def _intervals(text: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, text))
    text, start = text[order], start[order].astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(text))[1:] - 1
    return pa.RecordBatch.from_arrays([pa.array(text[first].astype(np.int64)), pa.array(start[first].astype(np.int32)), pa.array((start[last] + 1).astype(np.int32))], names=["num", "low", "high"])


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces with their minimiser as one symbol, and its bytes.

    It is the first gram of a piece with the hash ``key``: one further left would be the minimiser of the piece's first string.
    """
    raw, ends = words.buffers(batch.column("bytes"))
    place = np.arange(len(raw) - K + 1)
    grams = words.span_hashes(raw, place, place + K, lower=False)
    of = np.repeat(np.arange(batch.num_rows), np.diff(ends))[: len(place)]
    hits = np.flatnonzero(grams == batch.column("key").to_numpy().view(np.uint64)[of])
    found, first = np.unique(of[hits], return_index=True)
    middle = hits[first]
    if len(found) != batch.num_rows or np.any(middle + K > ends[1:]):
        raise ValueError("a piece without its minimiser")
    gram = raw[middle[:, None] + np.arange(K)]
    symbols = raw.copy()
    symbols[middle] = MARK
    stay = np.ones(len(raw), bool)
    stay[middle[:, None] + np.arange(1, K)] = False
    folded = _binary(symbols[stay], ends - (K - 1) * np.arange(len(ends)))
    minimiser = pa.Array.from_buffers(pa.binary(K), batch.num_rows, [None, pa.py_buffer(gram.tobytes())])
    return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("num"), batch.column("at"), folded, minimiser], names=["key", "num", "at", "bytes", "gram"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collections of about ``COLLECTION`` bytes, cut between minimisers, of batches sorted by minimiser."""
    held, size = [], 0

    def run(table: pa.Table) -> pa.RecordBatch:
        raw, ends = words.buffers(table["bytes"].combine_chunks())
        kind = table["gram"].combine_chunks().dictionary_encode().indices.to_numpy()
        return _intervals(*repeated_starts(raw, ends, table["num"].to_numpy(), table["at"].to_numpy().astype(np.int64), FOLDED, kind))

    for batch in (_folded(b.slice(low, ROWS)) for b in batches for low in range(0, b.num_rows, ROWS)):
        held.append(batch)
        size += batch.column("bytes").nbytes
        if size >= COLLECTION:
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield run(table.slice(0, cut))
            rest = table.slice(cut)
            held, size = rest.combine_chunks().to_batches(), sum(b.column("bytes").nbytes for b in rest.to_batches()) if cut else 0
    if held:
        yield run(pa.Table.from_batches(held))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of the pieces, with its text and place."""
    for batch in batches:
        raw, ends = words.buffers(batch.column("bytes"))
        counts = np.diff(ends) - LENGTH + 1
        start = words.ragged(ends[:-1], counts)
        of = np.repeat(np.arange(batch.num_rows), counts)
        half = words.span_hashes(raw, start, start + LENGTH // 2, lower=False)
        whole = words.span_hashes(raw, start, start + LENGTH, lower=False)
        at = batch.column("at").to_numpy().astype(np.int64)[of] + start - ends[of]
        yield pa.RecordBatch.from_arrays([pa.array(whole.astype(np.int64)), pa.array(half.astype(np.int64)), batch.column("num").take(pa.array(of)), pa.array(at.astype(np.int32))], names=["whole", "half", "num", "at"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, low, high = _flat(batch.column("intervals"), "low", "high")
        of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        for first, last, raw, ends in words.slices(batch.column("text"), CHUNK):
            part = slice(offsets[first], offsets[last])
            shift = ends[of[part] - first]
            gone = removed_bytes(len(raw), low[part] + shift, high[part] + shift)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            text_starts = ends[:-1][ends[:-1] < len(raw)]
            begins[text_starts] = gone[text_starts]
            removed, spans = words.sums(gone.astype(np.int64), ends), words.sums(begins.astype(np.int64), ends)
            rest = raw[~gone]
            cuts = ends - np.append(0, np.cumsum(removed))
            sha = [hashlib.sha256(rest[x:y]).hexdigest() for x, y in itertools.pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), pa.array(np.diff(ends)), pa.array(removed), pa.array(spans), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def removed_bytes(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes are covered by strings that start in the intervals ``[low, high)``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + LENGTH - 1, -1)
    return np.cumsum(change[:n], dtype=np.int32) > 0


def removal_intervals(rows: DataFrame) -> DataFrame:
    """``num, intervals``: the string starts to be removed of each text that has some."""
    long_ = rows.filter(F.octet_length("text") >= LENGTH).select("num", "text")
    repeated = materialize(long_.select("text").mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "keys")
    found = long_.mapInArrow(_occurrences, "key long, content long, num long, at int, count int").join(repeated, "key", "left_semi")
    found = materialize(found, "pieces")
    contents = materialize(found.groupBy("key", "content").agg(F.min(F.struct("num", "at")).alias("first"), F.any_value("count").alias("count"), F.count(F.lit(1)).alias("n")), "contents")
    copies = contents.filter("n > 1").select("key", "content", "first")
    again = found.join(copies, ["key", "content"]).filter(F.struct("num", "at") != F.col("first")).select("num", F.col("at").alias("low"), (F.col("at") + F.col("count")).alias("high"))
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    mixed = contents.join(several, "key").select("first.num", F.struct("key", F.col("first.at").alias("at"), "count").alias("piece"), "different")
    wanted = mixed.groupBy("num").agg(F.collect_list("piece").alias("wanted"))
    cut = long_.join(wanted, "num").mapInArrow(_cut, "key long, num long, at int, bytes binary").join(several, "key")
    cut = materialize(cut, "cut")
    compared = cut.filter(F.col("different") <= HOT).drop("different").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "num long, low int, high int")
    strings = cut.filter(F.col("different") > HOT).select("num", "at", "bytes").mapInArrow(_strings, "whole long, half long, num long, at int")
    strings = materialize(strings, "strings")
    firsts = strings.groupBy("whole", "half").agg(F.min(F.struct("num", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    split = strings.join(firsts, ["whole", "half"]).filter(F.struct("num", "at") != F.col("first")).select("num", F.col("at").alias("low"), (F.col("at") + 1).alias("high"))
    every = again.unionByName(compared).unionByName(split)
    intervals = materialize(every.groupBy("num").agg(F.collect_list(F.struct("low", "high")).alias("intervals")), "intervals")
    discard(repeated, found, contents, cut, strings)
    return intervals


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null counts as empty, and texts shorter than ``LENGTH`` bytes stay whole. Rows that
    repeat an identifier are documents of their own, ordered by text; null identifiers come last. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = numbered(docs)
    intervals = removal_intervals(rows)
    return rows.join(intervals, "num", "left").select("doc_id", "text", "intervals").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
SQL: dict[str, str] = {}
