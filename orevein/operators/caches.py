"""Semantic caches: entries by namespace, found again by cosine, replaced, evicted and invalidated; and their statistics.

What a request finds depends on all requests of its cache before it, so a cache is replayed in order: one pass over
rows sorted by cache and time, holding at most ``size`` entries. Different caches are replayed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orevein.functions import constants as K

OUTCOME = "cache string, seq long, op string, outcome string, similarity double, query string, value string, entries int, evicted int"


@dataclass(frozen=True)
class Settings:
    threshold: float = K.CACHE_THRESHOLD
    replace: float = K.CACHE_REPLACE
    size: int = K.CACHE_SIZE
    ttl_s: float = K.CACHE_TTL_S


RETRIEVAL = Settings()
#: Whole answers are reused only for all but equal questions.
ANSWERS = Settings(threshold=max(K.ANSWER_THRESHOLD, K.CACHE_THRESHOLD), size=max(64, K.CACHE_SIZE // 2))


class _Cache:
    """Entries of one cache in the order of their writing: namespace, unit vector, time, query, value."""

    def __init__(self, settings: Settings):
        self.settings, self.entries = settings, []

    def _closest(self, namespace: str, unit: np.ndarray) -> tuple[int, float]:
        own = [i for i, e in enumerate(self.entries) if e[0] == namespace and len(e[1]) == len(unit)]
        if not own:
            return -1, 0.0
        like = np.stack([self.entries[i][1] for i in own]) @ unit
        best = int(like.argmax())
        return own[best], float(like[best])

    def get(self, now: float, namespace: str, unit: np.ndarray | None):
        self.entries = [e for e in self.entries if e[0] != namespace or e[2] >= now - self.settings.ttl_s]
        at, similarity = self._closest(namespace, unit) if unit is not None else (-1, 0.0)
        if at < 0 or similarity < self.settings.threshold:
            return "miss", None, None, None, 0
        return "hit", similarity, self.entries[at][3], self.entries[at][4], 0

    def put(self, now: float, namespace: str, unit: np.ndarray | None, query: str, value: str):
        if unit is None or self.settings.size <= 0:
            return "ignored", None, query, value, 0
        at, similarity = self._closest(namespace, unit)
        entry = (namespace, unit, now, query, value)
        if at >= 0 and similarity >= self.settings.replace:
            self.entries[at] = entry
            return "replaced", similarity, query, value, 0
        self.entries.append(entry)
        over = len(self.entries) - self.settings.size
        if over > 0:  # the oldest of the whole cache go, whatever their namespace
            oldest = sorted(range(len(self.entries)), key=lambda i: (self.entries[i][2], self.entries[i][0], i))[:over]
            self.entries = [e for i, e in enumerate(self.entries) if i not in set(oldest)]
        return "appended", None, query, value, max(0, over)

    def invalidate(self):
        gone, self.entries = len(self.entries), []
        return "invalidated", None, None, None, gone


def _unit(vector: list | None) -> np.ndarray | None:
    if vector is None or any(x is None for x in vector):
        return None
    x = np.asarray(vector, np.float64)
    length = np.sqrt(x @ x)
    return x / length if np.isfinite(length) and length >= 1e-12 else None


def replay(requests: DataFrame, settings: Settings = RETRIEVAL) -> DataFrame:
    """The outcome of every request ``cache, ts, seq, op (get | put | invalidate), namespace, vector, query, value``.

    Outcomes: ``hit``, ``miss``; ``appended``, ``replaced``, ``ignored`` (a zero or null vector); ``invalidated``. Requests
    of a cache follow ``ts``, then ``seq``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, cache = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if cache is None or r["cache"] != name:
                    name, cache = r["cache"], _Cache(settings)
                now, unit = r["at"], _unit(r["vector"])
                if r["op"] == "get":
                    found = cache.get(now, r["namespace"], unit)
                elif r["op"] == "put":
                    found = cache.put(now, r["namespace"], unit, r["query"], r["value"])
                else:
                    found = cache.invalidate()
                out.append((name, r["seq"], r["op"], *found[:4], len(cache.entries), found[4]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cache", "seq", "op", "outcome", "similarity", "query", "value", "entries", "evicted"])

    rows = requests.select("cache", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("seq").cast("long").alias("seq"), "op", F.coalesce("namespace", F.lit("_")).alias("namespace"), F.col("vector").cast("array<double>").alias("vector"), "query", "value")
    return rows.repartition("cache").sortWithinPartitions("cache", "at", "seq").mapInArrow(run, OUTCOME)


def stats(outcomes: DataFrame) -> DataFrame:
    """Per cache: hits, misses, hit rate (0 without requests), writes by kind, evictions and the entries held at the end."""
    hits, misses = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "miss")
    return outcomes.groupBy("cache").agg(
        hits.alias("hits"),
        misses.alias("misses"),
        F.round(F.coalesce(hits / F.nullif(hits + misses, F.lit(0)), F.lit(0.0)), 4).alias("hit_rate"),
        F.count_if(F.col("outcome") == "appended").alias("appended"),
        F.count_if(F.col("outcome") == "replaced").alias("replaced"),
        F.sum(F.when(F.col("op") == "put", F.col("evicted")).otherwise(0)).alias("evicted"),
        F.count_if(F.col("outcome") == "invalidated").alias("generation"),
        F.max_by("entries", "seq").alias("entries"),
    )


def eviction_order(entries: DataFrame, size: int = K.CACHE_SIZE, by: str = "cache") -> DataFrame:
    """``entries(by, created_at, namespace, entry_id)`` with their place in the order of eviction (oldest first) and whether they go to leave ``size``."""
    order = Window.partitionBy(by).orderBy("created_at", "namespace", "entry_id")
    total = F.count(F.lit(1)).over(Window.partitionBy(by))
    return entries.withColumn("place", F.row_number().over(order)).withColumn("evicted", F.col("place") <= total - size)
