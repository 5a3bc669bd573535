"""Queries of sources, chunking, memory, caches, metrics, answers and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from orevein.functions import chunking as C
from orevein.functions import constants as K
from orevein.functions import text as T
from orevein.functions.text import sentences
from orevein.functions.vectors import cosine, dot, normalised
from orevein.operators import answer, fusion, memory, search
from orevein.plans import composed
from orevein.plans import sqltext as S
from orevein.plans.indexes import text_index
from orevein.plans.search_queries import query_vectors, rounded, vectors
from orevein.registry import query
from orevein.session import load
from orevein.sources.loaders import blocks_of, csv_blocks


@query("html_blocks")
def html_blocks(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks_of(F.col("html"), "html")).alias("pos", "b")).select("page_id", "pos", "b.*")


@query("markdown_blocks")
def markdown_blocks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks_of(F.col("text"), "text")).alias("pos", "b")).select("doc_id", "pos", "b.*")


@query("csv_rows", "SELECT 'c_custkey: ' || c_custkey || chr(10) || 'c_mktsegment: ' || c_mktsegment AS text FROM customer")
def csv_rows(spark, sf_dir):
    return csv_blocks(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query("recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.recursive_pieces(F.col("text"))).alias("pos", "piece"))


@query("document_chunks")
def document_chunks(spark, sf_dir):
    return C.chunks(load(spark, sf_dir, "documents"))


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


_LINES = "x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(
    "section_group",
    f"WITH {_LINES}, h AS (SELECT *, length(text) < 12 AS head FROM x) SELECT doc_id, line_no, sum(head::INT) OVER w AS section, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER w AS title FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)",
)
def section_group(spark, sf_dir):
    blocks = _lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("pos"), "text", F.when(F.length("text") < 12, "heading").otherwise("paragraph").alias("kind"), F.lit(1).alias("level"))
    return C.sections(blocks).select("doc_id", F.col("pos").alias("line_no"), "section", F.try_element_at("path", F.lit(1)).alias("title"))


@query(
    "record_label_schema",
    rf"""WITH {composed.PAPERS}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM papers),
l AS (SELECT doc_id, line_no, regexp_matches(text, {S.literal(C.QUESTION_LABEL)}) AS question, trim(regexp_extract(text, '^\s*([A-Z][A-Za-z][A-Za-z ''/-]{{1,38}})\.(\s+\S)', 1)) AS label FROM x),
f AS (SELECT doc_id, CASE WHEN question THEN 'Q' ELSE label END AS label, count(*) AS n, min(line_no) AS first FROM l WHERE question OR (label <> '' AND len(regexp_split_to_array(label, '\s+')) <= 4 AND lower(label) NOT IN ({S.quoted(C.NOT_LABELS)})) GROUP BY ALL)
SELECT doc_id, label, n, row_number() OVER (PARTITION BY doc_id ORDER BY first, label) AS place FROM f""",
)
def record_label_schema(spark, sf_dir):
    lines = composed.papers(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return C.label_schema(lines, 1)


@query("table_split")
def table_split(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.table_pieces(F.col("text"))).alias("pos", "piece"))


_WINDOWS = "w AS (SELECT doc_id, text, g::INT AS lo0, least(g + 700, length(text))::INT AS hi0 FROM documents, LATERAL (SELECT unnest(generate_series(0, length(text) - 1, 580)) AS g) s WHERE length(text) > 0)"


@query(
    "parent_window",
    rf"""WITH {_WINDOWS}, p AS (SELECT *, greatest(0, 1800 - (hi0 - lo0)) // 2 AS pad FROM w), b AS (SELECT *, greatest(0, lo0 - pad)::INT AS low, least(length(text), hi0 + pad)::INT AS high FROM p),
s AS (SELECT *, instr(substr(text, low + 1, lo0 - low), chr(10) || chr(10)) AS ahead, instr(reverse(substr(text, hi0 + 1, high - hi0)), chr(10) || chr(10)) AS behind FROM b),
c AS (SELECT *, CASE WHEN ahead > 0 AND low + ahead + 1 < lo0 THEN low + ahead + 1 ELSE low END AS a, CASE WHEN behind > 0 AND high - behind - 1 > hi0 THEN high - behind - 1 ELSE high END AS z FROM s),
t AS (SELECT *, regexp_replace(substr(text, a::INT + 1, (z - a)::INT), '^\s+|\s+$', '', 'g') AS win FROM c)
SELECT doc_id, lo0 // 580 AS pos, CASE WHEN pad > 0 AND length(win) > hi0 - lo0 + 80 THEN md5(win) END AS parent FROM t""",
)
def parent_window(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", "text", F.posexplode(T.char_windows(F.col("text"))).alias("pos", "piece"))
    start = F.col("pos") * (K.CHUNK_SIZE - K.CHUNK_OVERLAP)
    return chunks.select("doc_id", "pos", F.md5(C.parent_window(F.col("text"), start, start + F.length("piece"))).alias("parent"))


_MARK_Q, _MARK_A = r"(?:Q\d*[.:)]|Question\s*\d*[.:])", r"(?:A\d*[.:)]|Answer\s*\d*[.:])"


@query(
    "faq_pairs",
    rf"""WITH {composed.PAPERS}, p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?i)(?:^|\n)\s*{_MARK_Q}\s*')[2:]) AS part, generate_subscripts(regexp_split_to_array(text, '(?i)(?:^|\n)\s*{_MARK_Q}\s*')[2:], 1) - 1 AS pos FROM papers),
q AS (SELECT doc_id, pos, trim(regexp_replace(regexp_extract(part, '(?is)^(.+?)\n\s*{_MARK_A}\s*(.+)$', 1), '\s+', ' ', 'g')) AS q, trim(regexp_replace(regexp_extract(part, '(?is)^(.+?)\n\s*{_MARK_A}\s*(.+)$', 2), '\s+', ' ', 'g')) AS a FROM p)
SELECT doc_id, pos, 'Q: ' || q || chr(10) || 'A: ' || a AS pair FROM q WHERE q <> '' AND a <> ''""",
)
def faq_pairs(spark, sf_dir):
    return composed.papers(spark, sf_dir).select("doc_id", F.posexplode(C.faq_pairs(F.col("text"))).alias("pos", "pair"))


@query("records")
def records(spark, sf_dir):
    return composed.books(spark, sf_dir).select("doc_id", F.explode(C.records(F.col("text"))).alias("r")).select("doc_id", "r.*")


def _turns(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


_PAIRS = "p AS (SELECT conv_id AS session, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), h AS (SELECT session, turn, question, text AS answer, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS back FROM p WHERE role <> 'user' AND before = 'user' QUALIFY back <= 8)"


@query("history_pairs", f"WITH {_PAIRS} SELECT * FROM h")
def history_pairs(spark, sf_dir):
    return memory.history_pairs(_turns(spark, sf_dir))


@query("turn_retention", "SELECT conv_id AS session, count(*) AS kept, min(turn) AS first_turn FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id")
def turn_retention(spark, sf_dir):
    return memory.retained_turns(_turns(spark, sf_dir), 4).groupBy("session").agg(F.count(F.lit(1)).alias("kept"), F.min("turn").alias("first_turn"))


@query("transcript", f"WITH {_PAIRS} SELECT session, string_agg('User: ' || question || chr(10) || 'Assistant: ' || answer, chr(10) ORDER BY turn) AS transcript FROM h GROUP BY session")
def transcript(spark, sf_dir):
    return memory.transcript(_turns(spark, sf_dir))


@query("sticky_slot", "SELECT event_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS slot FROM events")
def sticky_slot(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("slot", F.when(F.col("value") > 50, F.col("event_type")))
    return memory.sticky(rows, "slot", "user_id", ("ts", "event_id")).select("event_id", "slot")


@query(
    "session_ttl",
    "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g",
)
def session_ttl(spark, sf_dir):
    return memory.sessions(load(spark, sf_dir, "events")).select("event_id", "session_no")


@query(
    "latency_percentiles",
    "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type",
)
def latency_percentiles(spark, sf_dir):
    return rounded(memory.latency_report(load(spark, sf_dir, "events"), "event_type", "value"), "p50", "p95", "p99", "mean")


@query("rolling_window", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 512) GROUP BY event_type")
def rolling_window(spark, sf_dir):
    last = memory.rolling(load(spark, sf_dir, "events"), by="event_type", order=("ts", "event_id"))
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("hit_rate", "SELECT user_id, round(coalesce(sum((value > 50)::INT) / nullif(count(*), 0), 0), 6) AS rate FROM events GROUP BY user_id")
def hit_rate(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.coalesce(F.sum((F.col("value") > 50).cast("int")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 6).alias("rate"))


@query(
    "cache_probe",
    f"WITH {S.DENSE} SELECT query_id, id AS entry_id, round(score, 6) AS similarity FROM dense JOIN embeddings e ON e.vec_id = id JOIN embeddings q ON q.vec_id = query_id WHERE e.label = q.label AND score >= 0.97 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1",
)
def cache_probe(spark, sf_dir):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    v = vectors(spark, sf_dir)
    cache = v.select(F.col("id").alias("entry_id"), F.col("label").alias("namespace"), "vector", F.lit("2024-01-01 00:05:00").cast("timestamp").alias("created_at"))
    asked = query_vectors(spark, sf_dir).join(v.select(F.col("id").alias("query_id"), F.col("label").alias("namespace")), "query_id").withColumn("ts", now)
    return rounded(memory.nearest_cached(asked, cache), "similarity")


@query("cosine_pairs", f"WITH {S.DENSE} SELECT query_id, round(avg(list_cosine_similarity(q.vector, e.vector)), 6) AS mean_cosine FROM (SELECT DISTINCT query_id FROM dense) d JOIN v q ON q.vec_id = d.query_id, v e GROUP BY query_id")
def cosine_pairs(spark, sf_dir):
    """The mean cosine with all vectors, which is the product with their mean direction: one row, whatever the table holds."""
    parts = vectors(spark, sf_dir).select(F.posexplode(normalised(F.col("vector"))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    both = query_vectors(spark, sf_dir).crossJoin(F.broadcast(mean))  # one row
    length = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return both.select("query_id", F.round(cosine(F.col("vector"), F.col("mean")) * length, 6).alias("mean_cosine"))


@query("list_documents", "SELECT source AS doc_id, count(*) AS chunks, list_sort(list(DISTINCT lang)) AS districts, min(doc_id) AS first_id FROM documents GROUP BY source")
def list_documents(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("district"), F.col("lang").alias("topic"), F.col("doc_id").cast("string").alias("source"), F.col("doc_id").alias("chunk_index"))
    return memory.list_documents(rows).select("doc_id", "chunks", "districts", F.col("source").cast("long").alias("first_id"))


@query("upsert_snapshot", "SELECT doc_id AS id, lang FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'new2' FROM documents WHERE doc_id % 10 = 0")
def upsert_snapshot(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    tens = docs.filter("id % 10 = 0")
    new = tens.withColumn("lang", F.lit("new1")).withColumn("seq", F.lit(1)).unionByName(tens.withColumn("lang", F.lit("new2")).withColumn("seq", F.lit(2)))
    return memory.upsert(docs, new)


@query("delete_document", "SELECT count(*) AS left_over, (SELECT count(*) FROM documents WHERE source = 'src3') AS removed FROM documents WHERE source <> 'src3'")
def delete_document(spark, sf_dir):
    chunks = load(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"))
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    kept = memory.delete_document(chunks, "src3").agg(F.count(F.lit(1)).alias("left_over"))
    return kept.crossJoin(F.broadcast(total)).select("left_over", (F.col("total") - F.col("left_over")).alias("removed"))  # one row each


_HITS = f"WITH {S.DENSE}, h AS (SELECT query_id, id, rank, score, ((id * 7919) % 101) / 10.0 - 5 AS precise FROM {S.top('dense', 16)})"


def _hits(spark, sf_dir):
    hits = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir), K.CANDIDATE_CAP)
    return hits.withColumn("precise", F.pmod(F.col("id") * 7919, F.lit(101)) / 10.0 - 5)


@query(
    "cascade_rerank",
    f"""{_HITS}, c AS (SELECT *, min(precise) FILTER (rank <= 4) OVER (PARTITION BY query_id) AS floor, max(score) OVER (PARTITION BY query_id) AS top, count(*) OVER (PARTITION BY query_id) AS n FROM h)
SELECT query_id, id, round(CASE WHEN n <= 4 THEN score WHEN rank <= 4 THEN precise ELSE floor - 1 - (coalesce(nullif(top, 0), 1) - score) END, 6) AS rerank_score FROM c""",
)
def cascade_rerank(spark, sf_dir):
    return rounded(fusion.cascade(_hits(spark, sf_dir), "score", "precise"), "rerank_score").select("query_id", "id", "rerank_score")


@query("rerank_threshold", f"{_HITS} SELECT query_id, id, round(1 / (1 + exp(-precise)), 6) AS shown FROM h WHERE precise >= -2.0")
def rerank_threshold(spark, sf_dir):
    kept = _hits(spark, sf_dir).filter(F.col("precise") >= K.RERANK_THRESHOLD)
    return rounded(kept.withColumn("shown", fusion.final_score(F.col("precise"), F.col("score"), F.col("score"))), "shown").select("query_id", "id", "shown")


@query(
    "select_budget",
    f"""WITH RECURSIVE {S.DENSE}, h AS (SELECT query_id, id, rank, length(text) AS len FROM {S.top("dense", 16)} JOIN documents ON doc_id = id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h),
f AS (SELECT query_id, n, id, least(len, 6000) AS used, 1 AS position, true AS taken, least(len, 6000) AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.query_id, o.n, o.id, CASE WHEN f.position < 5 AND f.used + o.len <= 6000 THEN f.used + o.len ELSE f.used END, CASE WHEN f.position < 5 AND f.used + o.len <= 6000 THEN f.position + 1 ELSE f.position END, f.position < 5 AND f.used + o.len <= 6000, o.len
  FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1)
SELECT query_id, position, id, kept AS kept_length FROM f WHERE taken""",
)
def select_budget(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("len"))
    return fusion.select_budget(_hits(spark, sf_dir).join(docs, "id"), "len")


@query(
    "context_block",
    f"""WITH {S.DENSE}, h AS (SELECT query_id, rank AS position, '[' || rank || '] (' || source || ')' || chr(10) || text AS block FROM {S.top("dense", 5)} JOIN documents ON doc_id = id),
c AS (SELECT query_id, position, CASE WHEN position = 1 THEN substr(block, 1, 6000) ELSE block END AS block FROM h),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY position) AS upto FROM c)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY position)) AS context, count(*) AS used FROM u WHERE upto <= 6000 OR position = 1 GROUP BY query_id""",
)
def context_block(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("header"), F.col("text").alias("body"))
    hits = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir), K.TOP_K).join(docs, "id").withColumnRenamed("rank", "position")
    return answer.context_block(hits).withColumn("context", F.md5("context"))


@query("citation_resolve", f"WITH {S.DENSE} SELECT query_id, 0 AS use, rank AS position, id FROM {S.top('dense', 5)} WHERE rank = 3 UNION ALL SELECT query_id, 1, rank, id FROM {S.top('dense', 5)} WHERE rank = 1")
def citation_resolve(spark, sf_dir):
    context = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir), K.TOP_K).select("query_id", F.col("rank").alias("position"), "id")
    answers = context.select("query_id").distinct().withColumn("answer", F.lit("Yes [3], then [1][3] and [9] or [0]."))
    return answer.citations(answers, context).select("query_id", "use", "position", "id")




@query("extractive_sentences")
def extractive_sentences(spark, sf_dir):
    items, docs = load(spark, sf_dir, "benchmark", "documents")
    both = items.join(docs, items["item_id"] == docs["doc_id"]).select(F.col("item_id").alias("id"), items["text"].alias("question"), sentences(docs["text"], 0).alias("sentences"))
    return answer.best_sentences(both)


_VISEMES = "v AS (SELECT user_id AS utterance_id, event_id * 40.0 AS offset_ms, (event_id % 22)::INT // 4 * 4 AS viseme_id FROM events)"


@query(
    "viseme_cues",
    f"""WITH {_VISEMES},
s AS (SELECT *, offset_ms / 1000 AS st, substr('{K.VISEME_SHAPES}', viseme_id + 1, 1) AS value, row_number() OVER w AS n, coalesce(lead(offset_ms / 1000) OVER w, offset_ms / 1000 + 0.08) AS en FROM v WINDOW w AS (PARTITION BY utterance_id ORDER BY offset_ms, viseme_id)),
e AS (SELECT utterance_id, n, st, CASE WHEN en - st < 0.03 THEN st + 0.03 ELSE en END AS en, value FROM s UNION ALL SELECT utterance_id, 0, 0.0, st, 'X' FROM s WHERE n = 1 AND offset_ms > 30),
r AS (SELECT *, sum(ch) OVER (PARTITION BY utterance_id ORDER BY n) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY utterance_id ORDER BY n) THEN 0 ELSE 1 END AS ch FROM e)),
c AS (SELECT utterance_id, run, min(st) AS st, arg_max(en, n) AS en, any_value(value) AS value FROM r GROUP BY ALL),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY utterance_id ORDER BY run DESC) = 1)
SELECT utterance_id, round(st, 6) AS start, round(en, 6) AS "end", value FROM c UNION ALL SELECT utterance_id, round(en, 6), round(en + 0.12, 6), 'X' FROM l WHERE value <> 'X'""",
)
def viseme_cues(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    visemes = events.select(F.col("user_id").alias("utterance_id"), (F.col("event_id") * F.lit(40.0)).alias("offset_ms"), (F.floor((F.col("event_id") % 22) / 4) * 4).cast("int").alias("viseme_id"))
    durations = visemes.select("utterance_id").distinct().withColumn("duration_s", F.lit(0.0))
    return rounded(answer.mouth_cues(visemes, durations), "start", "end")


@query("posting_terms", f"WITH {S.bm25()} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term")
def posting_terms(spark, sf_dir):
    return text_index(spark, sf_dir).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query("unique_values", "SELECT source, count(*) AS n_unique FROM (SELECT n_chars, min(source) AS source FROM documents GROUP BY n_chars HAVING count(*) = 1) GROUP BY source")
def unique_values(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("n_chars").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n")).filter("n = 1").groupBy("source").agg(F.count(F.lit(1)).alias("n_unique"))


@query("nearest_rank", "SELECT event_type, list_sort(list(value))[(count(*) * 0.95)::DECIMAL(20,4)::DOUBLE::BIGINT * 0 + floor(count(*) * 0.95)::BIGINT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_rank(spark, sf_dir):
    return memory.nearest_rank(load(spark, sf_dir, "events"), 0.95, "event_type", "value").select("event_type", F.col("value").alias("p95"))


