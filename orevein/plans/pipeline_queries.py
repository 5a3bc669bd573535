"""The entry points as queries, caches, checks of answers, and stream operators run over tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from orevein.functions import judges as J
from orevein.functions.models import hashed_embedding
from orevein.operators import answer, caches, memory, search
from orevein.plans import composed as C
from orevein.plans import retrieval
from orevein.plans import sqltext as S
from orevein.plans.indexes import chunk_index
from orevein.plans.search_queries import vectors
from orevein.registry import query
from orevein.session import load
from orevein.streaming import speculation

lit = S.literal


@query("ingest_chunks")
def ingest_chunks(spark, sf_dir):
    return chunk_index(spark, sf_dir).chunks.select("chunk_id", "doc_id", "chunk_index", "total_chunks", "section", "char_start", "char_end", "is_record", "record_name", "constituency", "district", "category", "header", "text", "parent_text")


@query("chunk_totals", f"WITH {C.PAPERS} SELECT (SELECT count(*) FROM papers) + (SELECT count(DISTINCT c_nationkey) FROM customer) AS documents")
def chunk_totals(spark, sf_dir):
    """Every document of the chunk index, with or without chunks, has a line in the report."""
    index = chunk_index(spark, sf_dir)
    return retrieval.ingest_report(C.library(spark, sf_dir), index).agg(F.count(F.lit(1)).alias("documents"))


@query("record_chunks", f"WITH {C.PROFILES} SELECT nation + 1000000 AS doc_id, row_number() OVER (PARTITION BY nation ORDER BY key) - 1 AS chunk_index, count(*) OVER (PARTITION BY nation) AS total_chunks, title || ' ' || given || ' ' || family AS record_name, seat AS constituency, md5(record) AS digest FROM profiles")
def record_chunks(spark, sf_dir):
    """The records of the chunk index against the rows they were made from."""
    rows = chunk_index(spark, sf_dir).chunks.filter("is_record")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "record_name", "constituency", F.md5("text").alias("digest"))


@query("record_summary", f"WITH {C.PROFILES} SELECT nation + 1000000 AS doc_id, count(*) AS records, min(length(record)) AS min_chars, max(length(record)) AS max_chars, round(avg(length(record)), 4) AS avg_chars, count(*) AS named FROM profiles GROUP BY nation")
def record_summary(spark, sf_dir):
    n = F.length("text")
    rows = chunk_index(spark, sf_dir).chunks.filter("is_record")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("records"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 4).alias("avg_chars"), F.count("record_name").alias("named"))


@query("collection_totals", "SELECT count(DISTINCT source) AS total_documents, count(*) AS total_chunks FROM documents")
def collection_totals(spark, sf_dir):
    return memory.totals(load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id")))


@query("counters", "SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def counters(spark, sf_dir):
    return memory.counters(load(spark, sf_dir, "events"), "event_type")


@query("listing_page", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25 OFFSET 50")
def listing_page(spark, sf_dir):
    return search.page(load(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 25, 50)


# --- questions to records, and over the chunk index
ASKED = [("What are the assets of ", ""), ("When was ", " born"), ("Which languages are known to ", ""), ("What is the education of ", "")]


@query(
    "record_answers",
    f"""WITH {C.PROFILES}, n AS (SELECT *, title || ' ' || given || ' ' || family AS name FROM profiles)
SELECT key AS query_id, CASE WHEN key % 5 = 0 THEN 'I don''t have a profile for Tom Hart in the documents.' ELSE name || CASE key % 4
  WHEN 0 THEN ' has declared movable assets Rs. ' || movable || ' lakh, immovable assets Rs. ' || immovable || ' crore, liabilities Rs. ' || liabilities || ' lakh.'
  WHEN 1 THEN ' was born on ' || born || ', in ' || place || '.' WHEN 2 THEN ' speaks Telugu, ' || given || 'ish.' ELSE '''s education: Degree of ' || seat || ' college.' END || ' [1]' END AS answer FROM n""",
)
def record_answers(spark, sf_dir):
    """What each record answers to a question about one of its fields; every fifth question is about somebody else."""
    rows = C.profiles(spark, sf_dir)
    name, k = F.concat_ws(" ", "title", "given", "family"), F.col("key")
    question = F.concat(C.pick([q for q, _ in ASKED], k), name, C.pick([q for _, q in ASKED], k))
    person = F.when(k % 5 == 0, "Tom Hart").otherwise(F.concat_ws(" ", "given", "family"))
    asked = rows.select(k.alias("query_id"), F.lit(1).alias("position"), question.alias("question"), person.alias("person"), F.col("record").alias("chunk_text"), F.lit(True).alias("is_record"), name.alias("record_name"), name.alias("record_title"))
    return answer.extractive(asked)


def _questions(spark, sf_dir):
    """Every benchmark passage and every user turn as a question."""
    items = load(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("query_id"), "text")
    turns = C.utterances(spark, sf_dir).filter("role = 'user'").select((F.col("id") + 2_000_000_000).alias("query_id"), "text")
    return items.unionByName(turns)


@query("retrieve_pipeline")
def retrieve_pipeline(spark, sf_dir):
    return retrieval.retrieve(chunk_index(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", "status", "relaxed", "position", "id", "doc_id", "source", "score", "dense_score", "rrf_score", "rerank_score", "retriever", F.md5("text").alias("text"))


@query("answer_pipeline")
def answer_pipeline(spark, sf_dir):
    return retrieval.answer(chunk_index(spark, sf_dir), _questions(spark, sf_dir))


@query("understood", f"WITH {C.UTTERED} SELECT count(*) AS questions FROM uttered WHERE role = 'user'")
def understood(spark, sf_dir):
    rows = C.utterances(spark, sf_dir).filter("role = 'user'").select(F.col("id").alias("query_id"), "text")
    return retrieval.understand(rows).agg(F.count("effective").alias("questions"))


@query("hashed_embeddings")
def hashed_embeddings(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", hashed_embedding(F.col("text")).alias("vector"))


# --- caches: each label's vectors are put into the cache of their number, then asked for again
def _requests(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    cache, at = F.concat(F.lit("c"), (F.col("id") % 4).cast("string")), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 1000)
    common = [cache.alias("cache"), at.alias("ts"), F.col("label").cast("string").alias("namespace"), "vector", F.col("id").cast("string").alias("query"), F.col("id").cast("string").alias("value")]
    gets = rows.select(*common, (F.col("id") * 2).alias("seq"), F.lit("get").alias("op"))
    return gets.unionByName(rows.select(*common, (F.col("id") * 2 + 1).alias("seq"), F.lit("put").alias("op")))


@query("cache_replay")
def cache_replay(spark, sf_dir):
    return caches.replay(_requests(spark, sf_dir))


@query("answer_cache_replay")
def answer_cache_replay(spark, sf_dir):
    return caches.replay(_requests(spark, sf_dir), caches.ANSWERS)


@query("cache_stats")
def cache_stats(spark, sf_dir):
    return caches.stats(caches.replay(_requests(spark, sf_dir)))


@query(
    "eviction_order",
    "SELECT event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS place, place <= count(*) OVER (PARTITION BY user_id) - 20 AS evicted FROM events".replace("place <=", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) <="),
)
def eviction_order(spark, sf_dir):
    entries = load(spark, sf_dir, "events").select(F.col("user_id").alias("cache"), F.col("ts").alias("created_at"), F.col("event_type").alias("namespace"), F.col("event_id").alias("entry_id"))
    return caches.eviction_order(entries, 20).select("entry_id", "place", "evicted")


# --- checks of answers: what a record's fields say, judged against the fields it was made from
_SAID = "CASE key % 4 WHEN 0 THEN 'Assets: Rs. ' || movable || ' lakh [1].' WHEN 1 THEN 'I do not have that.' WHEN 2 THEN title || ' ' || given || ' was born on ' || born || '.' ELSE 'Hello there.' END"
_CHECKS = "CASE key % 3 WHEN 0 THEN 'refusal' WHEN 1 THEN 'conversational' ELSE 'no_fabrication' END"


@query(
    "answer_checks",
    rf"""WITH {C.PEOPLE}, a AS (SELECT *, {_SAID} AS said, {_CHECKS} AS kind, CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END AS cited FROM people),
f AS (SELECT *, key % 4 IN (0, 2) AS figure, key % 4 = 2 AS named FROM a),
v AS (SELECT kind, CASE kind WHEN 'refusal' THEN CASE WHEN named THEN 'names' WHEN figure THEN 'figure' WHEN key % 4 <> 1 THEN 'not declined' END
  WHEN 'conversational' THEN CASE WHEN named THEN 'names' WHEN figure THEN 'figure' WHEN cited > 0 THEN 'cited' END ELSE CASE WHEN figure AND cited = 0 THEN 'uncited figure' END END AS why FROM f)
SELECT kind, coalesce(why, 'pass') AS verdict, count(*) AS n FROM v GROUP BY ALL""",
)
def answer_checks(spark, sf_dir):
    """Verdicts by kind of check, and how many answers each met."""
    rows = C.people(spark, sf_dir)
    k = F.col("key") % 4
    said = F.when(k == 0, F.concat(F.lit("Assets: Rs. "), "movable", F.lit(" lakh [1]."))).when(k == 1, "I do not have that.").when(k == 2, F.concat("title", F.lit(" "), "given", F.lit(" was born on "), "born", F.lit("."))).otherwise("Hello there.")
    kind = F.when(F.col("key") % 3 == 0, "refusal").when(F.col("key") % 3 == 1, "conversational").otherwise("no_fabrication")
    why = J.verdict(kind, said, F.when(k == 0, 1).otherwise(0), F.array("given"), F.lit(True))
    return rows.select(kind.alias("kind"), F.coalesce(why, F.lit("pass")).alias("verdict")).groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("stated_values", f"WITH {C.PROFILES} SELECT key, true AS born, movable = movable AS movable, false AS other FROM profiles")
def stated_values(spark, sf_dir):
    """Whether a record states its own date and amount, and a value that none holds."""
    return C.profiles(spark, sf_dir).select("key", J.stated(F.col("record"), F.col("born")).alias("born"), J.stated(F.col("record"), F.col("movable")).alias("movable"), J.stated(F.col("record"), F.lit("777777")).alias("other"))


@query("filter_escapes", r"""SELECT doc_id, replace(replace(source || '"' || chr(92) || lang, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') AS escaped FROM documents""")
def filter_escapes(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", search.escaped(F.concat("source", F.lit('"\\'), "lang")).alias("escaped"))


# --- streams over tables
@query("debounce_partials")
def debounce_partials(spark, sf_dir):
    """User turns replayed as partials 100 ms apart, the last of each conversation as the final, with the embedding of their text."""
    users = load(spark, sf_dir, "conversations").filter("role = 'user'")
    last = users.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ms = F.lit(1_700_000_000_000) + F.col("turn") * 100
    rows = users.join(last, "conv_id").select(F.col("conv_id").cast("string").alias("session_id"), ms.alias("ms"), F.when(F.col("turn") == F.col("last"), "final").otherwise("partial").alias("kind"), "text", hashed_embedding(F.col("text")).alias("embedding"))
    events = rows.repartition("session_id").sortWithinPartitions("session_id", "ms").mapInArrow(_replay, "session_id string, ms long, event string, text string, similarity double")
    return events.select("session_id", F.timestamp_millis("ms").alias("ts"), "event", "text", "similarity")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    session, state = None, None
    for batch in batches:
        out = []
        for e in batch.to_pylist():
            if e["session_id"] != session or state is None:
                session, state = e["session_id"], speculation.Speculation()
            out += [(session, e["ms"], *f) for f in state.event(e["kind"], float(e["ms"]), e["text"], e["embedding"])]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["session_id", "ms", "event", "text", "similarity"])


@query("speculation_stats")
def speculation_stats(spark, sf_dir):
    return speculation.speculation_stats(debounce_partials(spark, sf_dir))


@query("playback_order", "SELECT conv_id AS utterance_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 = turn AS ready FROM conversations WHERE (conv_id + turn) % 5 <> 0")
def playback_order(spark, sf_dir):
    """Turns as parts of an utterance of which every fifth has not arrived: those after a gap are not to be played yet."""
    rows = load(spark, sf_dir, "conversations").filter("(conv_id + turn) % 5 <> 0").select(F.col("conv_id").alias("utterance_id"), F.col("turn").alias("seq"))
    return speculation.in_order(rows)


@query(
    "event_order",
    f"""WITH p AS (SELECT conv_id * 100 + turn AS query_id, role, text, string_split(text, chr(10)) AS parts FROM conversations),
e AS (SELECT query_id, 0 AS seq, 'retrieval' AS event, turn0::VARCHAR AS data FROM (SELECT query_id, query_id % 3 AS turn0 FROM p)
  UNION ALL SELECT query_id, generate_subscripts(parts, 1), 'delta', unnest(parts) FROM p UNION ALL SELECT query_id, len(parts) + 1, 'final', role FROM p)
SELECT query_id, seq::BIGINT AS seq, event, data FROM e""",
)
def event_order(spark, sf_dir):
    """What a turn's text, sent line by line after its hits, looks like on the wire."""
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("role").alias("status"), F.col("text").alias("answer"))
    hits = turns.select("query_id", F.explode(F.sequence(F.lit(0), (F.col("query_id") % 3).cast("int"))).alias("position")).filter("position > 0")
    return speculation.answer_events(turns, hits, F.split("answer", "\n")).withColumn("seq", F.col("seq").cast("long"))
