"""Queries of places, people, namespaces, cache writes, cues and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orevein.functions import constants as K
from orevein.functions import entities as E
from orevein.functions.text import terms
from orevein.operators import search
from orevein.plans.search_queries import rounded, vectors
from orevein.registry import query
from orevein.session import load

@query("cache_replace", "WITH p AS (SELECT a.vec_id AS new_id, b.vec_id AS old_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id < a.vec_id) SELECT new_id, max(s) >= 0.995 AS replaces FROM p GROUP BY new_id")
def cache_replace(spark, sf_dir):
    """Whether each entry would replace an earlier one of its namespace (the label) or be appended; the first of a namespace has none."""
    v = vectors(spark, sf_dir).withColumnRenamed("label", "namespace")
    best = search.dense_topk(v, v.withColumnRenamed("id", "query_id"), 1, same="namespace", earlier=True)
    return best.select(F.col("query_id").alias("new_id"), (F.col("score") >= K.CACHE_REPLACE).alias("replaces"))


@query(
    "letter_cues",
    """WITH l AS (SELECT conv_id * 100 + turn AS id, regexp_extract_all(lower(text), '\\p{L}') AS letters FROM conversations),
x AS (SELECT id, len(letters) AS n, unnest(letters) AS c, generate_subscripts(letters, 1) - 1 AS pos FROM l),
s AS (SELECT *, CASE WHEN contains('pbm', c) THEN 'A' WHEN contains('ijky', c) THEN 'B' WHEN contains('eltdnh', c) THEN 'C' WHEN c = 'a' THEN 'D' WHEN c = 'o' THEN 'E' WHEN contains('uwr', c) THEN 'F' WHEN contains('fv', c) THEN 'G' WHEN contains('szc', c) THEN 'H' ELSE 'C' END AS value FROM x),
r AS (SELECT *, sum(ch) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY id ORDER BY pos) THEN 0 ELSE 1 END AS ch FROM s))
SELECT id, round(min(pos) * (3.0::DOUBLE / min(n)) + 1e-9, 6) AS start, round((max(pos) + 1) * (3.0::DOUBLE / min(n)) + 1e-9, 6) AS "end", any_value(value) AS value FROM r GROUP BY id, run
UNION ALL SELECT id, CASE WHEN len(letters) = 0 THEN 0.0 ELSE 3.0 END, CASE WHEN len(letters) = 0 THEN 3.0 ELSE 3.1 END, 'X' FROM l""",
)
def letter_cues(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.lit(3.0).alias("duration_s"))
    # a hair more, so that no time lies just between two rounded ones
    return rounded(E.letter_cues(turns).withColumns({c: F.col(c) + 1e-9 for c in ("start", "end")}), "start", "end")


@query("hashed_sparse")
def hashed_sparse(spark, sf_dir):
    counts = E.hashed_counts(load(spark, sf_dir, "documents").select("doc_id", terms(F.col("text")).alias("terms")))
    return counts.select("doc_id", F.size("counts").alias("n"))


@query("record_stats", "SELECT lang, count(*) AS records, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 4) AS avg_chars, count_if(source = 'src1') AS named FROM documents GROUP BY lang")
def record_stats(spark, sf_dir):
    n = F.length("text")
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 4).alias("avg_chars"), F.count_if(F.col("source") == "src1").alias("named"))


@query("component_health", "SELECT user_id, max(CASE WHEN value > 90 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) AS severity FROM events GROUP BY user_id")
def component_health(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("value") > 90, 2).when(F.col("value") > 50, 1).otherwise(0)).alias("severity"))


@query("line_pages", "WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, pos, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts FROM x")
def line_pages(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "pos", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("starts"))


