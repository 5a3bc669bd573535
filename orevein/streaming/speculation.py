"""Streams: speculative retrieval over partial input, sticky slots and metrics.

The debounce depends on the last partial that *fired*, so it is keyed state, not a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orevein.functions import constants as K

OUTPUT = "session_id string, ts timestamp, event string, text string, similarity double"
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stable(text: str | None) -> bool:
    """Whether a partial is worth a search: long enough, enough words, not cut inside one."""
    bare = (text or "").strip()
    return len(bare) >= K.PARTIAL_MIN_CHARS and sum(len(w) > 1 for w in bare.split()) >= K.PARTIAL_MIN_TOKENS and not bare.endswith("-")


def similarity(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if scale < 1e-12 else float(a @ b / scale)


class Speculation:
    """State of one session: when a search last fired, and the searches since, newest last."""

    def __init__(self, last: float | None = None, runs: list | None = None, latency_ms: float = 150.0):
        self.last, self.runs, self.latency_ms = last, runs or [], latency_ms

    def event(self, kind: str, ms: float, text: str, vector) -> list[tuple[str, str, float | None]]:
        return {"final": self.final, "reset": self.reset}.get(kind, self.partial)(ms, text, vector)

    def reset(self, ms: float, text: str, vector) -> list[tuple[str, str, float | None]]:
        """The speaker broke in or left: a running search is cancelled and everything forgotten."""
        out = [("cancelled", r[1], None) for r in self.runs[-1:] if r[0] + self.latency_ms > ms]
        self.last, self.runs = None, []
        return [*out, ("reset", text, None)]

    def partial(self, ms: float, text: str, vector) -> list[tuple[str, str, float | None]]:
        if not stable(text) or (self.last is not None and ms - self.last < K.DEBOUNCE_MS):
            return [("skipped", text, None)]
        out = [("cancelled", self.runs[-1][1], None)] if self.runs and self.runs[-1][0] + self.latency_ms > ms else []
        done = [r for r in self.runs if r[0] + self.latency_ms <= ms]
        self.runs = [*done[-K.RING :], (ms, text, list(vector))]
        self.last = ms
        return [*out, ("fired", text, None)]

    def final(self, ms: float, text: str, vector) -> list[tuple[str, str, float | None]]:
        """Reuse the finished search most like the final text, else a running one; discard them if none is close."""
        ranked = sorted(((r[0] + self.latency_ms <= ms, similarity(r[2], vector), r[1]) for r in self.runs), reverse=True)
        close = next((r for r in ranked if r[1] >= K.REUSE_THRESHOLD), None)
        out = [("reused", close[2], close[1])] if close else [("discarded", r[2], r[1]) for r in ranked[:1]] + [("fresh", text, None)]
        self.last, self.runs = None, []
        return out


def _ttl(seconds: int | None) -> int | None:
    return seconds * 1000 if seconds else None


def _time_mode(ttl_s: int | None) -> str:
    """State expires by the clock; a query over what is available now, which would wait for that for ever, takes no TTL."""
    return "processingTime" if ttl_s else "none"


class SpeculationProcessor(StatefulProcessor):
    def __init__(self, ttl_s: int | None = None):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a session that goes silent leaves nothing behind
        self.last = handle.getValueState("last", "ms double", ttlDurationMs=_ttl(self.ttl_s))
        self.runs = handle.getListState("runs", "ms double, text string, vector array<double>", ttlDurationMs=_ttl(self.ttl_s))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "kind"])
        last = self.last.get()[0] if self.last.exists() else None
        state = Speculation(last, [tuple(r) for r in self.runs.get()] if self.runs.exists() else [])
        out = []
        for e in events.itertuples():
            out += [(key[0], e.ts, *f) for f in state.event(e.kind, e.ts.timestamp() * 1000, e.text, e.embedding)]
        if state.last is None:
            self.last.clear()
        else:
            self.last.update((state.last,))
        self.runs.put([(ms, t, list(v)) for ms, t, v in state.runs]) if state.runs else self.runs.clear()
        yield pd.DataFrame(out, columns=["session_id", "ts", "event", "text", "similarity"])

    def close(self) -> None:
        pass


def speculate(partials: DataFrame, ttl_s: int | None = K.SESSION_TTL_S) -> DataFrame:
    """Events of a stream ``session_id, ts, kind (partial | final | reset), text, embedding``; needs ``STATE_STORE`` as state store.

    The state of a session is dropped ``ttl_s`` after its last change; None keeps it, as ``availableNow`` needs.
    """
    return partials.groupBy("session_id").transformWithStateInPandas(SpeculationProcessor(ttl_s), outputStructType=OUTPUT, outputMode="Append", timeMode=_time_mode(ttl_s))


def metrics(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts, sums and maxima per key and window of a stream ``key, ts, value_ms``; state older than ``late`` goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value_ms").alias("total"), F.max("value_ms").alias("max")).select("window.start", "key", "n", "total", "max")


def session_windows(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of a stream ``key, ts``: events with less than ``gap`` between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", "key", "n")


def speculation_stats(events: DataFrame, by: str = "session_id") -> DataFrame:
    """Per session: searches fired, cancelled, reused, discarded and partials skipped; the share of finals that reused one (0 without any)."""
    n = lambda name: F.count_if(F.col("event") == name)
    rate = F.coalesce(n("reused") / F.nullif(n("reused") + n("discarded"), F.lit(0)), F.lit(0.0))
    return events.groupBy(by).agg(*[n(name).alias(name) for name in ("fired", "cancelled", "reused", "discarded", "skipped")], F.round(rate, 3).alias("reuse_rate"))


def split_off(held: str, piece: str) -> tuple[list[str], str]:
    """Sentences that are over now that ``piece`` has come, and the beginning of the next."""
    parts = SENTENCE_GAP.split(held + piece)
    return [p for p in parts[:-1] if p.strip()], parts[-1]


def emitted_sentences(pieces: list[str]) -> list[str]:
    """Sentences as a text arrives in pieces: each leaves once a later one has begun, the rest at the end."""
    out, held = [], ""
    for piece in pieces:
        done, held = split_off(held, piece)
        out += done
    return out + ([held] if held.strip() else [])


SENTENCES = "utterance_id string, ts timestamp, sentence string"


class SentenceProcessor(StatefulProcessor):
    """The open sentence of an utterance; ``done`` sends what is left."""

    def __init__(self, ttl_s: int | None = None):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string", ttlDurationMs=_ttl(self.ttl_s))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.held.get()[0] if self.held.exists() else "", []
        for e in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            done, held = split_off(held, e.piece or "")
            if e.done and held.strip():
                done, held = [*done, held], ""
            out += [(key[0], e.ts, s.strip()) for s in done]
        if held:
            self.held.update((held,))
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=["utterance_id", "ts", "sentence"])

    def close(self) -> None:
        pass


def sentences_as_they_end(pieces: DataFrame, ttl_s: int | None = K.SESSION_TTL_S) -> DataFrame:
    """Sentences of a stream ``utterance_id, ts, seq, piece, done``, each as soon as the next begins; ``ttl_s`` as in ``speculate``."""
    return pieces.groupBy("utterance_id").transformWithStateInPandas(SentenceProcessor(ttl_s), outputStructType=SENTENCES, outputMode="Append", timeMode=_time_mode(ttl_s))


def in_order(events: DataFrame, key: str = "utterance_id", number: str = "seq") -> DataFrame:
    """``events`` with ``ready``: whether every earlier number of the key (from 0) is there too, so that it may be played."""
    order = Window.partitionBy(key).orderBy(number)
    return events.withColumn("ready", F.row_number().over(order) - 1 == F.col(number))


def answer_events(answers: DataFrame, hits: DataFrame, parts: Column) -> DataFrame:
    """``query_id, seq, event, data`` of each answer as it is sent: what was retrieved, the parts of the text, then the whole with its status.

    ``parts`` is an array over a row of ``answers(query_id, status, answer)``; an answer without parts goes out whole.
    """
    found = hits.filter("position is not null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = answers.join(found, "query_id", "left").withColumn("parts", F.when(F.size(parts) > 0, parts).otherwise(F.array("answer")))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    every = F.concat(F.array(event("retrieval", F.coalesce("n", F.lit(0)).cast("string"))), F.transform("parts", lambda p: event("delta", p)), F.array(event("final", F.col("status"))))
    return rows.select("query_id", F.posexplode(every).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")
