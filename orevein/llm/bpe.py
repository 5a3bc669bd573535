"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a batch that the task hasn't met are laid out as one row of symbols, with an
index of all occurrences of mergeable pairs in it. In each word ranks are applied in ascending order,
all places of a pair left to right, and each merge drops the entries of the pairs it breaks and enters
the new ones. Merging a pair can only make pairs of higher rank in a trained vocabulary; should a lower
one appear, it comes next. Words of up to ``WAVE_BYTES`` bytes go together, all by one rank a wave, with
the index as an array by place; for longer ones it maps each pair to its places, and ranks with places
wait in a heap, so that no word is read once a rank. Encoded words are kept in a cache of bounded size,
the older half of which is dropped when it is full; a text is the concatenation of its words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.session import load

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 200_000
WAVE_BYTES = 64
NONE = np.iinfo(np.int32).max


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 signs stand for themselves, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE model with word ends, read from a ``tokenizer.json``: NFC, lower case, words split by a pattern, bytes as letters."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        if max(self.vocab.values(), default=0) >= 1 << 16:
            raise ValueError("pairs are keyed by two numbers of 16 bits")
        self.parts = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank_of: dict[int, int] = {}
        for rank, (a, b, _) in enumerate(self.parts):
            self.rank_of.setdefault((a << 16) | b, rank)
        keys = np.array(sorted(self.rank_of), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([self.rank_of[k] for k in keys.tolist()], np.int32)
        self.merged = np.array([m for _, _, m in self.parts], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = _byte_letters()
        self.inner = np.array([self.vocab[x] for x in letters], np.int32)
        self.final = np.array([self.vocab[x + self.suffix] for x in letters], np.int32)
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens as they stand."""
        if self.marks and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += [*self._plain(text[at : m.start()]), m.group()]
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sigma's lower case doesn't depend on its place here
        return self.words.findall(text.lower())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, ``NONE`` for pairs that don't merge."""
        keys = (left.astype(np.int64) << 16) | right
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == keys, self.pair_ranks[found], NONE)

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and the ``len(words) + 1`` bounds of the words among them."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        joined = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols, final = self.inner[joined], np.zeros(len(joined), bool)
        symbols[ends - 1] = self.final[joined[ends - 1]]
        final[ends - 1] = True
        long = np.repeat(sizes > WAVE_BYTES, sizes)
        for part, merge in ((~long, self._in_waves), (long, self._by_lists)):
            if part.any():
                symbols[part] = merge(symbols[part], final[part])
        kept = symbols >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        return symbols[kept], upto[np.concatenate([[0], ends])]

    def _in_waves(self, symbols: np.ndarray, final: np.ndarray) -> np.ndarray:
        """The merged symbols at their first places, -1 elsewhere; ``final`` marks the last symbol of each word.

        The index holds the rank of the pair that starts at each place. A wave takes the lowest of each
        word and applies it wherever the word has it, left to right; places are looked up anew only
        beside a merge, and words without an entry left drop out.
        """
        out = np.full(len(symbols), -1, symbols.dtype)
        at, index = np.arange(len(symbols)), np.full(len(symbols), NONE, np.int32)
        index[:-1] = self._ranks(symbols[:-1], symbols[1:])
        index[final] = NONE
        while len(symbols):
            last = np.flatnonzero(final)
            first = np.concatenate([[0], last[:-1] + 1])
            lowest = np.repeat(np.minimum.reduceat(index, first), last - first + 1)
            live = lowest != NONE
            out[at[~live]] = symbols[~live]
            hits = np.flatnonzero((index == lowest) & live)
            gaps = np.diff(hits, prepend=-2)
            if (gaps == 1).any():  # a symbol paired with itself: every other place of a run
                places = np.arange(len(hits))
                hits = hits[(places - np.maximum.accumulate(np.where(gaps > 1, places, 0))) % 2 == 0]
            symbols[hits] = self.merged[index[hits]]
            final[hits] = final[hits + 1]
            live[hits + 1] = False
            fresh = np.cumsum(live)[hits] - 1
            symbols, final, at, index = symbols[live], final[live], at[live], index[live]
            fresh = np.concatenate([fresh, fresh[fresh > 0] - 1])
            index[fresh] = NONE
            fresh = fresh[~final[fresh]]
            index[fresh] = self._ranks(symbols[fresh], symbols[fresh + 1])
        return out

    def _by_lists(self, symbols: np.ndarray, final: np.ndarray) -> np.ndarray:
        """As :meth:`_in_waves`, with a list of places for each pair and a heap of ranks: a word costs in proportion to its length, however long."""
        n = len(symbols)
        ranks = self._ranks(symbols[:-1], symbols[1:])
        ranks[final[:-1]] = NONE
        at = np.flatnonzero(ranks != NONE)
        ranks = ranks[at]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        active, cuts = np.unique(ranks, return_index=True)
        where = dict(zip(active.tolist(), (x.tolist() for x in np.split(at, cuts[1:])), strict=True)) if len(at) else {}
        active = active.tolist()  # sorted, so it is a heap

        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.flatnonzero(final)
        right[last], left[0], left[last[:-1] + 1] = n, -1, -1
        symbols, right, left = [*symbols.tolist(), -2], right.tolist(), left.tolist()
        rank_of, parts = self.rank_of.get, self.parts
        while active:
            rank = heapq.heappop(active)
            a, b, merged = parts[rank]
            positions = where.pop(rank)
            positions.sort()
            for i in positions:
                if symbols[i] != a:
                    continue
                j = right[i]
                if symbols[j] != b:
                    continue
                symbols[i], symbols[j] = merged, -1
                after, before = right[j], left[i]
                right[i] = after
                if after < n:
                    left[after] = i
                    new = rank_of((merged << 16) | symbols[after])
                    if new is not None:
                        if new in where:
                            where[new].append(i)
                        else:
                            where[new] = [i]
                            heapq.heappush(active, new)
                if before >= 0:
                    new = rank_of((symbols[before] << 16) | merged)
                    if new is not None:
                        if new in where:
                            where[new].append(before)
                        else:
                            where[new] = [before]
                            heapq.heappush(active, new)
        return np.array(symbols[:-1])

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        ids, bounds = self.merge_all(new)
        raw, names, bounds = ids.astype("<u4").tobytes(), [self.names[i] for i in ids.tolist()], bounds.tolist()
        for word, a, b in zip(new, bounds, bounds[1:], strict=False):
            self.cache[word] = (raw[4 * a : 4 * b], " ".join(names[a:b]))

    def encode(self, texts: list[str | None]) -> list[list[tuple[bytes, str]]]:
        """For each text its words' ids (as bytes) and decoded forms."""
        split = [self.split(t) if t else [] for t in texts]
        needed = set().union(*split)
        new = needed.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS // 2:
            self.older, self.cache, new = self.cache, {}, needed
        known = [w for w in new if w in self.older]
        self.cache.update((w, self.older[w]) for w in known)
        new = new.difference(known)
        specials = new & self.special.keys()
        self.learn(new - specials)
        for s in specials:
            self.cache[s] = (np.array([self.special[s]], "<u4").tobytes(), s)
        cache = self.cache
        return [[cache[w] for w in ws] for ws in split]

    def decode(self, ids: list[int]) -> str:
        """The model has no decoder, so a text is its tokens with spaces between them."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=4)
def model(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _groups(texts: pa.Array, size: int = 1 << 20):
    """Lists of texts of about ``size`` characters together."""
    group, held = [], 0
    for t in texts:
        t = t.as_py()
        group.append(t)
        held += len(t or "")
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group
    words.trim()


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the token ids of each whole text (null as empty)."""
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        out = [np.frombuffer(b"".join([w[0] for w in ws]), "<i4") for group in _groups(texts) for ws in model(path).encode(group)]
        return pa.array(out, pa.list_(pa.int32()))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``out_col``, the text of each row of ids (null as no ids)."""
    path = path or default_path()

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([model(path).decode(row or []) for row in ids.to_pylist()], pa.string())

    return tokens.withColumn(out_col, text(F.col(ids_col)))


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Texts are encoded whole and decoded again; of both only the digests leave the task. Null and empty
    texts have no tokens and decode to the empty text. Repeated rows are encoded each, an empty table
    gives an empty result, and other columns of ``docs`` are ignored.
    """
    path = path or default_path()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        n, ids_sha, text_sha = [], [], []
        for group in _groups(texts):
            for ws in model(path).encode(group):
                ids = b"".join([w[0] for w in ws])
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([w[1] for w in ws]).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}
