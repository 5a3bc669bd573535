"""Conversation memory, sessions, caches and metrics: windows and aggregates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orevein.functions import constants as K
from orevein.functions.vectors import normalised
from orevein.operators.search import dense_topk


def history_pairs(turns: DataFrame, n: int = K.MEMORY_TURNS) -> DataFrame:
    """``session, turn, question, answer`` of the last ``n`` pairs: each reply with the latest user turn not yet answered."""
    ordered = Window.partitionBy("session").orderBy("turn")
    rows = turns.withColumn("before", F.lag(F.struct("role", "text")).over(ordered))
    pairs = rows.filter((F.col("role") != "user") & (F.col("before.role") == "user")).select("session", "turn", F.col("before.text").alias("question"), F.col("text").alias("answer"))
    recent = Window.partitionBy("session").orderBy(F.desc("turn"))
    return pairs.withColumn("back", F.row_number().over(recent)).filter(F.col("back") <= n)


def with_last_question(turns: DataFrame) -> DataFrame:
    """``turns`` with ``last_user``, the question of the latest answered pair before each turn."""
    ordered = Window.partitionBy("session").orderBy("turn")
    rows = turns.withColumn("__before", F.lag(F.struct("role", "text")).over(ordered))
    answered = F.when((F.col("role") != "user") & (F.col("__before.role") == "user"), F.col("__before.text"))
    rows = rows.withColumn("__answered", answered)
    return rows.withColumn("last_user", F.last("__answered", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))).drop("__before", "__answered")


def retained_turns(turns: DataFrame, n: int = 2 * K.MEMORY_TURNS) -> DataFrame:
    """The last ``n`` turns of each session."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))).filter(F.col("back") <= n)


def transcript(turns: DataFrame, n: int = K.MEMORY_TURNS) -> DataFrame:
    """The last ``n`` pairs of each session as alternating lines."""
    line = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), "answer")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return history_pairs(turns, n).groupBy("session").agg(F.array_join(lines, "\n").alias("transcript"))


def sticky(events: DataFrame, slot: str, by: str = "session", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``slot`` filled with its last known value of the session."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(slot, F.last(slot, ignorenulls=True).over(upto))


def sessions(events: DataFrame, ttl_s: int = K.SESSION_TTL_S, by: str = "user_id") -> DataFrame:
    """``session_no`` of each event: a new one after an idle time of more than ``ttl_s``."""
    ordered = Window.partitionBy(by).orderBy("ts", "event_id")
    idle = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(ordered)
    fresh = F.when(idle.isNull() | (idle > ttl_s * 1_000_000), 1).otherwise(0)
    return events.withColumn("__fresh", fresh).withColumn("session_no", F.sum("__fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


RANK_BINS = 1024


def ranked_values(metrics: DataFrame, by: str, value: str, wanted: Column) -> DataFrame:
    """``by, r, value``: the values at the ranks (from 0) that ``wanted``, an array over ``n`` of each key, asks for, in ascending order.

    Two passes, so that no task sorts a hot key: values are counted in ``RANK_BINS`` equal bins of each key's range, and
    only the bins in which a wanted rank falls are sorted, each by itself.
    """
    rows = metrics.filter(F.col(value).isNotNull()).select(F.col(by).alias("k"), F.col(value).cast("double").alias("v"))
    span = rows.groupBy(F.col("k").alias("sk")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (RANK_BINS - 1))).otherwise(0).cast("int")
    binned = rows.join(span, F.col("k").eqNullSafe(F.col("sk"))).select("k", "v", "n", bin_.alias("b"))
    counts = binned.groupBy("k", "n", "b").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("k").orderBy("b"))  # at most RANK_BINS rows a key
    edges = counts.withColumn("before", upto - F.col("m")).withColumn("r", F.explode(F.array_distinct(wanted))).filter((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("m")))
    asked = edges.groupBy(F.col("k").alias("ak"), F.col("b").alias("ab")).agg(F.collect_set(F.struct((F.col("r") - F.col("before")).alias("place"), "r")).alias("ranks"))
    few = binned.join(asked, F.col("k").eqNullSafe(F.col("ak")) & (F.col("b") == F.col("ab")))
    placed = few.withColumn("i", F.row_number().over(Window.partitionBy("k", "b").orderBy("v")) - 1)
    hit = F.filter("ranks", lambda x: x["place"] == F.col("i"))
    return placed.filter(F.size(hit) > 0).select(F.col("k").alias(by), F.explode(F.transform(hit, lambda x: x["r"])).alias("r"), F.col("v").alias("value"))


def latency_report(metrics: DataFrame, by: str = "key", value: str = "value_ms") -> DataFrame:
    """Count, interpolated percentiles, mean and maximum per key; a key without values has a count of 0."""
    at = [(name, (F.col("n") - 1) * F.lit(q)) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    wanted = F.array(*[x.cast("long") for _, place in at for x in (F.floor(place), F.ceil(place))])
    values = ranked_values(metrics, by, value, wanted).groupBy(F.col(by).alias("__k")).agg(F.map_from_entries(F.collect_set(F.struct("r", "value"))).alias("at"))
    totals = metrics.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    low = lambda place: F.try_element_at("at", F.floor(place).cast("long"))
    high = lambda place: F.try_element_at("at", F.ceil(place).cast("long"))
    joined = totals.join(values, F.col(by).eqNullSafe(F.col("__k")), "left")
    return joined.select(by, "n", *[(low(p) + (high(p) - low(p)) * (p - F.floor(p))).alias(name) for name, p in at], "mean", "max")


def nearest_rank(metrics: DataFrame, q: float, by: str = "key", value: str = "value_ms") -> DataFrame:
    """``by, value``: the value at place ``floor(n * q)`` from 0 of each key, the last at most."""
    place = F.array(F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1).cast("long"))
    return ranked_values(metrics, by, value, place).select(by, "value")


def counters(events: DataFrame, by: str = "key", amount: str | None = None) -> DataFrame:
    """``by, total``: how often, or by how much, each counter was raised."""
    return events.groupBy(by).agg((F.sum(amount) if amount else F.count(F.lit(1))).alias("total"))


def rolling(metrics: DataFrame, n: int = K.METRIC_WINDOW, by: str = "key", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last ``n`` samples of each key."""
    return metrics.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(o) for o in order]))).filter(F.col("back") <= n)


def nearest_cached(queries: DataFrame, cache: DataFrame, threshold: float = K.CACHE_THRESHOLD, ttl_s: int = K.CACHE_TTL_S) -> DataFrame:
    """The most similar live entry of each query's namespace, at or above the threshold.

    Queries are broadcast in bounded blocks and meet the entries of their namespace by matrix products, as in dense
    search. Queries of one call share a moment (``ts`` of the latest): entries written after it or older than ``ttl_s``
    don't count.
    """
    now = queries.agg(F.max("ts").alias("now"))
    live = cache.crossJoin(F.broadcast(now)).filter((F.col("created_at") <= F.col("now")) & (F.unix_timestamp("now") - F.unix_timestamp("created_at") <= ttl_s))  # one row
    entries = live.select(F.col("entry_id").alias("id"), normalised(F.col("vector")).alias("vector"), "namespace")
    asked = queries.select("query_id", normalised(F.col("vector")).alias("vector"), "namespace")
    best = dense_topk(entries, asked, 1, same="namespace")
    return best.filter(F.col("score") >= threshold).select("query_id", F.col("id").alias("entry_id"), F.col("score").alias("similarity"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """``existing`` with rows of ``new`` in place of those with their keys; of a key repeated in ``new`` the last wins."""
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter("__n = 1").drop("__n", seq)
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def delete_document(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.filter(F.col("doc_id") != doc_id)


def totals(chunks: DataFrame) -> DataFrame:
    """``total_documents, total_chunks``; rows without a document count as chunks only."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count("doc_id").alias("total_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"))


def list_documents(chunks: DataFrame) -> DataFrame:
    """One row a document: chunks, distinct places and topics in order, first source."""
    return chunks.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_set("district")).alias("districts"), F.array_sort(F.collect_set("topic")).alias("topics"), F.min_by("source", "chunk_index").alias("source"))
