"""Queries of text functions and query understanding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orevein.functions import constants as K
from orevein.functions import text as T
from orevein.operators import fusion, search
from orevein.plans import composed as C
from orevein.plans import sqltext as S
from orevein.plans.search_queries import query_vectors, vectors
from orevein.plans.understanding_queries import _sql_tokens
from orevein.registry import query
from orevein.session import load, materialize

_CLEAN = "coalesce(text, '')"
for _a, _b in (("“", '"'), ("”", '"'), ("‘", "''"), ("’", "''"), ("–", "-"), ("—", "-"), (" ", " "), ("​", "")):
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"
for _a, _b in ((r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"\1\2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_a}', '{_b}', 'g')"


@query("clean_text", f"SELECT doc_id, length({_CLEAN}) AS n_chars, md5({_CLEAN}) AS digest FROM documents")
def clean_text(spark, sf_dir):
    out = T.clean(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(out).cast("long").alias("n_chars"), F.md5(out).alias("digest"))


@query(
    "detect_script_language",
    r"SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 4000), '[\x{0C00}-\x{0C7F}]') THEN 'te' WHEN regexp_matches(substr(text, 1, 4000), '[\x{0900}-\x{097F}]') THEN 'hi' WHEN regexp_matches(substr(text, 1, 4000), '[\x{0B80}-\x{0BFF}]') THEN 'ta' ELSE 'en' END AS script FROM documents",
)
def detect_script_language(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"))


@query("char_windows", "SELECT doc_id, generate_series // 580 AS window_no, substr(text, generate_series + 1, 700) AS piece FROM documents, generate_series(0, length(text) - 1, 580) WHERE length(text) > 0".replace("generate_series // 580", "g // 580").replace("substr(text, generate_series + 1, 700)", "substr(text, (g + 1)::INT, 700)").replace("generate_series(0, length(text) - 1, 580)", "LATERAL (SELECT unnest(range(0, length(text), 580)) AS g)"))
def char_windows(spark, sf_dir):
    pieces = F.posexplode(T.char_windows(F.col("text"))).alias("window_no", "piece")
    return load(spark, sf_dir, "documents").select("doc_id", pieces).withColumn("window_no", F.col("window_no").cast("long"))


@query("sentence_split")
def sentence_split(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "snippet",
    "WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substr(t, 1, 220), ' [^ ]*$', '') || '…' END AS snippet FROM f",
)
def snippet(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("doc_content_id", "SELECT doc_id, 'doc_' || substr(sha1(source || ':' || substr(text, 1, 20000)), 1, 16) AS content_id FROM documents")
def doc_content_id(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("source"), F.col("text")).alias("content_id"))


@query(
    "context_header",
    "SELECT doc_id, array_to_string(list_distinct_ordered, ' | ') AS header FROM (SELECT doc_id, CASE WHEN source = lang THEN [lang] ELSE [source, lang] END || ['a › b', 'file'] AS list_distinct_ordered FROM documents)",
)
def context_header(spark, sf_dir):
    path = T.strings(["x", "a", "b"])
    return load(spark, sf_dir, "documents").select("doc_id", T.context_header(F.col("source"), F.col("lang"), path, F.lit("file.md")).alias("header"))


_NAMED = f"""{C.PEOPLE}, {S.DENSE}, h AS (SELECT query_id, id, rank, 1.0::DOUBLE / (60 + rank) AS rrf_score FROM {S.top("dense", 30)}),
who AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN given || ' ' || family ELSE 'Tom Hart' END AS person FROM h JOIN people ON key = id WHERE rank = 3),
named AS (SELECT h.*, person, CASE WHEN id % 3 < 2 THEN title || ' ' || given || ' ' || family END AS name FROM h JOIN who USING (query_id) LEFT JOIN people ON key = id),
scored AS (SELECT *, {S.f1(_sql_tokens("person"), _sql_tokens("coalesce(name, '')"))} AS f1 FROM named)"""


def _named(spark, sf_dir):
    """Dense hits with the name of a person for two thirds of them; every other query asks for the third hit's person."""
    hits = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir)).withColumn("rrf_score", 1.0 / (60 + F.col("rank")))
    people = C.people(spark, sf_dir).select(F.col("key").alias("id"), F.concat_ws(" ", "given", "family").alias("bare"), "title")
    rows = materialize(hits.join(people, "id", "left"), "named")
    who = rows.filter("rank = 3 and bare is not null").select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("bare")).otherwise("Tom Hart").alias("person"))
    name = F.when(F.col("id") % 3 < 2, F.concat("title", F.lit(" "), "bare"))
    return rows.join(who, "query_id").withColumn("name", name).withColumn("f1", T.name_f1(F.col("person"), F.col("name"))).withColumn("is_record", F.col("name").isNotNull())


@query("entity_gate", f"WITH {_NAMED}, b AS (SELECT *, max(f1) OVER (PARTITION BY query_id) AS best FROM scored) SELECT query_id, id, f1, best < 0.6 AS absent FROM b WHERE name IS NULL OR (best >= 0.6 AND f1 >= best - 0.15)")
def entity_gate(spark, sf_dir):
    return fusion.entity_gate(_named(spark, sf_dir)).select("query_id", "id", "f1", (F.col("best_f1") < K.PERSON_MATCH).alias("absent"))


@query(
    "person_boost",
    f"WITH {_NAMED}, b AS (SELECT *, max(f1) OVER (PARTITION BY query_id) AS best, max(rrf_score) OVER (PARTITION BY query_id) AS top FROM scored) SELECT query_id, id, round(rrf_score + CASE WHEN best < 0.6 THEN 0 WHEN f1 >= 0.6 THEN top * (2 + f1) WHEN name IS NOT NULL THEN -0.75 * top ELSE 0 END, 6) AS rrf_score FROM b",
)
def person_boost(spark, sf_dir):
    no = F.lit(False)
    return fusion.boosted(_named(spark, sf_dir), no, no, no, F.col("f1"), F.col("is_record")).select("query_id", "id", F.round("rrf_score", 6).alias("rrf_score"))


@query(
    "mention_counts",
    """WITH m AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\\b(?:the|with|from)\\b')) AS word FROM conversations)
SELECT conv_id, word, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, word) AS rank FROM m GROUP BY conv_id, word""",
)
def mention_counts(spark, sf_dir):
    words = load(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:the|with|from)\b"), F.lit(0))).alias("word"))
    counted = words.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "word")))
