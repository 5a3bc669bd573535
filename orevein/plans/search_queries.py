"""Core search queries. Corpus: documents; queries: benchmark; the vector of a document or query is the embedding with its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.functions import constants as K
from orevein.functions.text import dedupe_prefix, terms
from orevein.functions.vectors import display_score
from orevein.operators import fusion, search
from orevein.operators.joins import small
from orevein.plans import sqltext as S
from orevein.plans.indexes import text_index
from orevein.registry import query
from orevein.session import load


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", terms(F.col("text")).alias("terms"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, v = load(spark, sf_dir, "benchmark", "embeddings")
    return items.join(v, items["item_id"] == v["vec_id"]).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("tokenize_terms", f"SELECT doc_id, array_to_string({S.terms('text')}, ' ') AS terms, len({S.terms('text')}) AS dl FROM documents")
def tokenize_terms(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("dl"))


@query(
    "bm25_corpus_stats",
    f"WITH {S.bm25()} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avgdl, sum(len(terms))::BIGINT AS total_length, (SELECT count(*) FROM df) AS vocabulary, (SELECT max(df) FROM df) AS max_df FROM d",
)
def bm25_corpus_stats(spark, sf_dir):
    index = text_index(spark, sf_dir)
    df = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).agg(F.count(F.lit(1)).alias("vocabulary"), F.max("df").alias("max_df"))
    return index.lengths.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("total_length")).crossJoin(F.broadcast(df))  # two rows in all


@query("bm25_topk", f"WITH {S.bm25()} SELECT query_id, id, rank, round(score, 6) AS score FROM {S.top('(SELECT query_id, id, round(score, 9) AS score FROM bm25)', 30)}")
def bm25_topk(spark, sf_dir):
    return rounded(search.bm25_topk(text_index(spark, sf_dir), asked(spark, sf_dir), digits=9), "score")


@query("bm25_topk_filtered", f"WITH {S.bm25('''lang = 'en' AND source IN ('src1', 'src2', 'src3')''')} SELECT query_id, id, rank, round(score, 6) AS score FROM {S.top('(SELECT query_id, id, round(score, 9) AS score FROM bm25)', 30)}")
def bm25_topk_filtered(spark, sf_dir):
    allowed = load(spark, sf_dir, "documents").filter((F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3")).select(F.col("doc_id").alias("id"))
    return rounded(search.bm25_topk(text_index(spark, sf_dir), asked(spark, sf_dir), allowed=allowed, digits=9), "score")


@query("dense_topk", f"WITH {S.DENSE} SELECT query_id, id, rank, round(score, 6) AS score FROM {S.top('dense', 30)}")
def dense_topk(spark, sf_dir):
    return rounded(search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir)), "score")


@query("dense_topk_filtered", f"WITH {S.DENSE} SELECT query_id, id, rank, round(score, 6) AS score FROM {S.top('(SELECT dense.* FROM dense JOIN embeddings ON vec_id = id WHERE label IN (1, 2))', 10)}")
def dense_topk_filtered(spark, sf_dir):
    return rounded(search.dense_topk(vectors(spark, sf_dir).filter(F.col("label").isin(1, 2)), query_vectors(spark, sf_dir), 10), "score")


@query(
    "dense_normalized",
    f"WITH {S.DENSE} SELECT query_id, id, rank, round(score, 6) AS score, round(CASE WHEN score < 0 THEN greatest(0.0, least(1.0, (score + 1) / 2)) ELSE least(1.0, score) END, 6) AS shown FROM {S.top('dense', 30)}",
)
def dense_normalized(spark, sf_dir):
    hits = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir))
    return rounded(hits.withColumn("shown", display_score(F.col("score"))), "score", "shown")


@query("candidate_threshold", f"WITH {S.DENSE} SELECT query_id, count(*) AS kept FROM {S.top('dense', 30)} WHERE CASE WHEN score < 0 THEN (score + 1) / 2 ELSE least(1.0, score) END >= 0.3 GROUP BY query_id")
def candidate_threshold(spark, sf_dir):
    hits = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir))
    return hits.filter(display_score(F.col("score")) >= K.SIMILARITY_THRESHOLD).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))


def _branches(spark, sf_dir) -> DataFrame:
    sparse = search.bm25_topk(text_index(spark, sf_dir), asked(spark, sf_dir), digits=9)
    dense = search.dense_topk(vectors(spark, sf_dir), query_vectors(spark, sf_dir))
    return fusion.branch(dense, "dense", K.DENSE_WEIGHT).unionByName(fusion.branch(sparse, "bm25", K.SPARSE_WEIGHT))


_FUSED = f"""{S.bm25()}, {S.DENSE},
b AS (SELECT query_id, id, 'dense' AS retriever, 1.0 AS weight, rank, score FROM {S.top("dense", 30)}
  UNION ALL SELECT query_id, id, 'bm25', 0.7, rank, score FROM {S.top("(SELECT query_id, id, round(score, 9) AS score FROM bm25)", 30)}),
f AS (SELECT query_id, id, sum(weight / (60 + rank)) AS rrf_score, max(score) FILTER (retriever = 'dense') AS dense_score, max(score) FILTER (retriever = 'bm25') AS sparse_score,
  min(rank) FILTER (retriever = 'dense') AS dense_rank, min(rank) FILTER (retriever = 'bm25') AS sparse_rank,
  CASE WHEN count(DISTINCT retriever) > 1 THEN 'hybrid' ELSE min(retriever) END AS retriever FROM b GROUP BY ALL)"""


@query("rrf_fusion", f"WITH {_FUSED} SELECT query_id, id, round(rrf_score, 9) AS rrf_score, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, dense_rank, sparse_rank, retriever FROM f")
def rrf_fusion(spark, sf_dir):
    return rounded(rounded(fusion.fuse(_branches(spark, sf_dir)), "dense_score", "sparse_score"), "rrf_score", digits=9)


@query(
    "rrf_multi",
    f"""WITH {S.DENSE}, {S.bm25()},
b AS (SELECT query_id, id, 'dense' AS retriever, 1.0 AS weight, rank, score FROM {S.top("dense", 30)}
  UNION ALL SELECT query_id, id, 'dense', 0.5, rank, score FROM {S.top("(SELECT b.item_id AS query_id, e.vec_id AS id, list_dot_product(q.vector, e.vector) AS score FROM benchmark b JOIN v q ON q.vec_id = b.item_id + 1, v e)", 30)}
  UNION ALL SELECT query_id, id, 'bm25', 0.7, rank, score FROM {S.top("(SELECT query_id, id, round(score, 9) AS score FROM bm25)", 30)})
SELECT query_id, id, round(sum(weight / (60 + rank)), 9) AS rrf_score, round(max(score) FILTER (retriever = 'dense'), 6) AS dense_score, arg_min(rank, -score) FILTER (retriever = 'dense') AS dense_rank FROM b GROUP BY ALL""",
)
def rrf_multi(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark")
    v = vectors(spark, sf_dir)
    variant = items.join(v, items["item_id"] + 1 == v["id"]).select(F.col("item_id").alias("query_id"), "vector")
    more = fusion.branch(search.dense_topk(v, variant), "dense", K.DENSE_WEIGHT * K.VARIANT_WEIGHT)
    fused = fusion.fuse(_branches(spark, sf_dir).unionByName(more))
    return rounded(rounded(fused, "dense_score"), "rrf_score", digits=9).select("query_id", "id", "rrf_score", "dense_score", "dense_rank")


_PREFIX = "substr(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 1, 160)"


@query(
    "hybrid_search_topk",
    f"""WITH {_FUSED},
u AS (SELECT f.* FROM f JOIN documents t ON t.doc_id = f.id QUALIFY row_number() OVER (PARTITION BY query_id, lang, {_PREFIX} ORDER BY round(rrf_score, 12) DESC, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, id) AS rank, id AS doc_id, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, round(rrf_score, 9) AS rrf_score, retriever
FROM u QUALIFY rank <= 5""",
)
def hybrid_search_topk(spark, sf_dir):
    fused = rounded(fusion.fuse(_branches(spark, sf_dir)), "rrf_score", digits=12)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", dedupe_prefix(F.col("text")).alias("prefix"))
    unique = fusion.content_dedupe(fused.join(docs, "id"), "lang", "prefix")
    best = search.top_k(unique, K.TOP_K, score="rrf_score")
    out = best.select("query_id", "rank", F.col("id").alias("doc_id"), "dense_score", "sparse_score", "rrf_score", "retriever")
    return rounded(rounded(out, "dense_score", "sparse_score"), "rrf_score", digits=9)


@query("content_dedupe", f"SELECT source, count(*) AS kept FROM (SELECT source FROM documents QUALIFY row_number() OVER (PARTITION BY source, {_PREFIX} ORDER BY doc_id) = 1) GROUP BY source")
def content_dedupe(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), "source", dedupe_prefix(F.col("text")).alias("prefix"), F.lit(1.0).alias("rrf_score"))
    return fusion.content_dedupe(docs, "source", "prefix").groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "metadata_boost",
    f"""WITH {_FUSED}
SELECT query_id, id, round(rrf_score + (CASE WHEN lang = 'en' THEN 0.15 ELSE 0 END + CASE WHEN label = 1 THEN 0.10 ELSE 0 END + CASE WHEN source = 'src1' THEN 0.12 ELSE 0 END) * max(rrf_score) OVER (PARTITION BY query_id), 9) AS rrf_score
FROM f LEFT JOIN documents ON doc_id = id LEFT JOIN embeddings ON vec_id = id""",
)
def metadata_boost(spark, sf_dir):
    docs, v = load(spark, sf_dir, "documents", "embeddings")
    meta = docs.select(F.col("doc_id").alias("id"), "lang", "source").join(v.select(F.col("vec_id").alias("id"), "label"), "id", "full")
    hits = fusion.fuse(_branches(spark, sf_dir)).join(meta, "id", "left")
    return rounded(fusion.boosted(hits, F.col("lang") == "en", F.col("label") == 1, F.col("source") == "src1"), "rrf_score", digits=9).select("query_id", "id", "rrf_score")


@query(
    "literal_lookup",
    """WITH l AS (SELECT item_id AS query_id, lower(text) AS v FROM benchmark WHERE text <> '')
SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM l JOIN documents ON contains(lower(text), v) QUALIFY rank <= 20""",
)
def literal_lookup(spark, sf_dir):
    docs, items = load(spark, sf_dir, "documents", "benchmark")
    literals = items.select(F.col("item_id").alias("query_id"), F.array("text").alias("variants"))
    return search.literal_hits(docs.select(F.col("doc_id").alias("id"), "text"), literals)


@query(
    "filter_relaxation",
    f"""WITH {S.bm25()},
o AS (SELECT query_id, id, round(score, 9) AS score, source = 'src' || (query_id % 40) AS fits FROM bm25 JOIN documents ON doc_id = id),
h AS (SELECT query_id, id, score, false AS relaxed FROM o WHERE fits UNION ALL SELECT query_id, id, score, true FROM o WHERE query_id NOT IN (SELECT query_id FROM o WHERE fits))
SELECT query_id, id, rank, relaxed FROM {S.top("h", 5)}""",
)
def filter_relaxation(spark, sf_dir):
    sources = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("key"))
    index, queries = text_index(spark, sf_dir), asked(spark, sf_dir)
    own = queries.withColumn("keys", F.array(F.concat(F.lit("src"), (F.col("query_id") % 40).cast("string"))))
    both = search.relax(search.bm25_topk(index, own, K.TOP_K, keys=sources, digits=9), search.bm25_topk(index, queries, K.TOP_K, digits=9), queries)
    return both.select("query_id", "id", "rank", "relaxed")


@query("fetch_by_ids", "SELECT pos, doc_id, lang FROM (VALUES (0, 7), (1, 3), (2, 999999999), (3, 11)) w(pos, id) JOIN documents ON doc_id = id")
def fetch_by_ids(spark, sf_dir):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 999999999), (3, 11)], "pos int, id long")
    docs = load(spark, sf_dir, "documents")
    return docs.join(small(wanted), docs["doc_id"] == wanted["id"]).select("pos", "doc_id", "lang")


@query("metadata_filter", "SELECT doc_id FROM documents WHERE lower(source) IN ('src1', 'src4') AND lang = 'en'")
def metadata_filter(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("district"), F.array("source").alias("districts"), F.col("lang").alias("language"))
    return docs.filter(search.metadata_filter({"districts": ["SRC1", "src4"], "language": "en"})).select("doc_id")
