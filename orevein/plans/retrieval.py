"""The entry points over DataFrames: ``ingest``, ``understand``, ``retrieve`` and ``answer``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orevein.functions import constants as K
from orevein.functions import places as P
from orevein.functions import rewrite as R
from orevein.functions import signals as G
from orevein.functions import text as T
from orevein.functions.chunking import chunks as chunk_rows
from orevein.functions.entities import person, reply_of, REPLIES
from orevein.functions.intent import intent
from orevein.functions.literals import holds_all, literals
from orevein.functions.models import encode_distinct, fast_score, precise_score
from orevein.functions.vectors import display_score
from orevein.operators import answer as answers
from orevein.operators import fusion, metadata, search
from orevein.operators.memory import nearest_cached
from orevein.operators.text_index import TextIndex
from orevein.session import materialize

Scorer = Callable[[Column, Column], Column]


@dataclass
class Index:
    """Parquet snapshots of chunks with their metadata, their vectors and their text index."""

    chunks: DataFrame
    vectors: DataFrame
    text: TextIndex

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.text.save(f"{path}/text")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        chunks = spark.read.parquet(f"{path}/chunks")
        return cls(chunks, spark.read.parquet(f"{path}/vectors"), TextIndex.load(spark, f"{path}/text", chunks.select("id", "text")))

    def upsert(self, more: Index) -> Index:
        """With the chunks of ``more``, which replace all those of their documents."""
        return self.without(more.chunks.select("doc_id").distinct())._plus(more)

    def without(self, documents: DataFrame) -> Index:
        """Without the chunks of ``documents(doc_id)``."""
        gone = materialize(self.chunks.join(documents, "doc_id", "left_semi").select("id"), "gone")
        return Index(materialize(self.chunks.join(gone, "id", "left_anti"), "chunks"), materialize(self.vectors.join(gone, "id", "left_anti"), "vectors"), self.text.remove(gone))

    def _plus(self, more: Index) -> Index:
        text = self.text._with(self.text.postings.unionByName(more.text.postings), self.text.lengths.unionByName(more.text.lengths))
        return Index(materialize(self.chunks.unionByName(more.chunks, allowMissingColumns=True), "chunks"), materialize(self.vectors.unionByName(more.vectors), "vectors"), text)


def open_index(spark: SparkSession, *paths: str) -> Index | None:
    """The first of several stored indexes that can be read; None if there is none."""
    for path in paths:
        try:
            found = Index.load(spark, path)
            found.chunks.limit(1).count()
            return found
        except Exception:  # the next place is tried
            continue
    return None


def drop_index(spark: SparkSession, path: str) -> bool:
    """Delete a stored index; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def ensure_index(spark: SparkSession, path: str, dim: int) -> Index | None:
    """The stored index if its vectors have ``dim`` components; one of another dimension is dropped."""
    found = open_index(spark, path)
    if found is not None and found.vectors.filter(F.size("vector") != dim).limit(1).count():
        drop_index(spark, path)
        return None
    return found


def ingest(docs: DataFrame, encoder=None, overrides: tuple[Column, Column, Column] | None = None) -> Index:
    """Metadata, chunks, terms and vectors of ``doc_id, text, source``; chunk numbers are stable for the same documents.

    ``overrides`` are columns of ``docs`` for category, place and topic. Documents without a chunk leave no row;
    ``ingest_report`` tells which.
    """
    text = T.clean(F.col("text"))
    rows = docs.withColumn("text", text).withColumn("file_name", F.coalesce("source", F.lit("")))
    meta = metadata.document_metadata(rows)
    if overrides:
        meta = metadata.override(meta, *overrides)
    meta = materialize(meta.withColumn("language", T.script_language(F.col("text"))), "documents")
    carried = ["category", "districts", "district", "state", "topics", "topic", "entities", "scheme_names", "party", "candidate", "source", "language"]
    made = chunk_rows(meta, category="category").join(meta.select("doc_id", *carried), "doc_id")
    made = metadata.chunk_metadata(made).withColumn("id", F.xxhash64("chunk_id"))
    made = made.withColumn("header", T.context_header(F.col("district"), F.when(F.col("category") != "other", F.replace(F.col("category"), F.lit("_"), F.lit(" "))), F.col("section_path"), F.col("source")))
    stored = materialize(made, "chunks")
    passage = F.when(F.col("header") != "", F.concat("header", F.lit("\n"), "text")).otherwise(F.col("text"))
    passages = stored.select("id", passage.alias("passage"))
    vectors = encode_distinct(passages, "passage", "vector", *([encoder] if encoder else []))
    return Index(stored, materialize(vectors.select("id", "vector"), "vectors"), TextIndex.build(stored.select("id", "text")))


def ingest_report(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id, chunks, category, district, error``: one row a document, also for those that gave nothing."""
    made = index.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.first("category").alias("category"))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    out = docs.select("doc_id", empty.alias("empty")).join(made, "doc_id", "left")
    return out.select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "category", F.when(F.col("chunks").isNull(), F.when(F.col("empty"), "no text").otherwise("no chunks")).alias("error"))


def understand(queries: DataFrame) -> DataFrame:
    """What ``retrieve`` asks of ``query_id, text`` (and, if there, ``last_user``, ``slot``, ``filters``).

    ``intent, clean, followup, effective, texts`` (the question and its variants), ``places`` (those to filter by, from
    explicit filters, the text or the session's slot), ``category, category_hint, topic_hint, person, literals``.
    """
    has = lambda c, kind: F.col(c) if c in queries.columns else F.lit(None).cast(kind)
    rows = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), has("last_user", "string").alias("last_user"), has("slot", "string").alias("slot"), has("filters", "map<string,string>").alias("explicit"))
    rows = rows.withColumns({"intent": intent(F.col("text")), "clean": R.cleaned(F.col("text")), "named": P.places(F.col("text"))})
    first = F.try_element_at("named", F.lit(1))
    follow = R.is_followup(F.col("clean"), F.col("last_user").isNotNull(), F.col("intent") != "factual", F.try_element_at(P.places(F.col("clean")), F.lit(1)))
    rows = rows.withColumn("followup", F.coalesce(follow, F.lit(False))).withColumn("effective", F.when(F.col("followup"), R.spliced(F.col("clean"), F.col("last_user"))).otherwise(F.col("clean")))
    place = F.coalesce(first, "slot")
    inferred = F.create_map(F.lit("district"), place, F.lit("districts"), F.when(F.size("named") > 1, F.array_join(F.slice("named", 1, 3), ";")))
    applied = R.merged_filters(F.coalesce("explicit", F.create_map().cast("map<string,string>")), inferred)
    rows = rows.withColumn("applied", applied).withColumn("person", person(F.col("effective")))
    many = F.coalesce(F.try_element_at("applied", F.lit("districts")), F.try_element_at("applied", F.lit("district")))
    return rows.select(
        "query_id", "text", "intent", "clean", "followup", "effective", "person", "applied",
        F.slice(R.distinct_queries(F.concat(F.array("effective"), R.expansions(F.col("effective"), place), F.array("text"))), 1, 3).alias("texts"),
        F.coalesce(F.split(many, ";"), F.array().cast("array<string>")).alias("places"),
        F.try_element_at("applied", F.lit("category")).alias("category"),
        G.category_hint(F.col("text")).alias("category_hint"), G.topic_hint(F.col("text")).alias("topic_hint"),
        literals(F.col("text"), 3).alias("literals"),
    )


def _chunk_keys() -> Column:
    """What filters can ask of a chunk, in any case: a place (its own or a listed one), a place with the category, the category."""
    own = F.transform(F.array_distinct(F.array_compact(F.concat(F.array("district"), "districts"))), F.lower)
    kind = F.lower("category")
    return F.concat(F.transform(own, lambda p: F.concat(p, F.lit("|*"))), F.transform(own, lambda p: F.concat(p, F.lit("|"), kind)), F.array(F.concat(F.lit("*|"), kind)))


def _query_keys() -> Column:
    kind = F.coalesce(F.lower("category"), F.lit("*"))
    return F.when(F.size("places") > 0, F.transform("places", lambda p: F.concat(F.lower(p), F.lit("|"), kind))).otherwise(F.array(F.concat(F.lit("*|"), kind)))


def _branches(index: Index, asked: DataFrame, filtered: bool, encoder, k: int) -> DataFrame:
    """Dense hits of every text of a query and BM25 hits of its first, with their weights; filters count before the ranking."""
    texts = asked.select("query_id", _query_keys().alias("keys"), F.posexplode("texts").alias("pos", "text"))
    embedded = materialize(encode_distinct(texts, "text", "vector", *([encoder] if encoder else [])).select("query_id", "keys", "pos", "vector"), "queries")
    sparse = search.bm25_scores(index.text, asked.select("query_id", T.terms(F.col("effective")).alias("terms")))
    vectors = index.vectors
    if filtered:
        keys = index.chunks.select("id", _chunk_keys().alias("own"))
        sparse = sparse.join(keys, "id").join(asked.select("query_id", _query_keys().alias("wanted")), "query_id").filter(F.arrays_overlap("own", "wanted"))
        vectors = vectors.join(keys.select("id", F.explode(F.array_distinct("own")).alias("key")), "id")
        embedded = embedded.select("query_id", "pos", "vector", F.explode("keys").alias("key"))
    out = fusion.branch(search.top_k(sparse, k), "bm25", K.SPARSE_WEIGHT)
    for share, which in ((1.0, "pos = 0"), (K.VARIANT_WEIGHT, "pos = 1"), (K.VARIANT_WEIGHT, "pos = 2")):
        hits = search.dense_topk(vectors, embedded.filter(which), k, same="key" if filtered else None)
        out = out.unionByName(fusion.branch(hits, "dense", K.DENSE_WEIGHT * share))
    return out


def retrieve(index: Index, queries: DataFrame, k: int = K.TOP_K, mode: str = "cascade", fast: Scorer = fast_score, precise: Scorer = precise_score, encoder=None, cache: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """``query_id, status, relaxed, position, id, doc_id, source, text, chunk_text, score, ...`` of ``query_id, text`` (see ``understand``).

    Status: ``small_talk`` (nothing is searched), ``cached`` (a like question of the cache), ``literal`` and
    ``literal_miss`` (the question holds a distinctive value: only chunks with it), ``normal``, ``best_effort`` (nothing
    reached the threshold: the best candidate), ``off_topic`` (the best is far below it), ``absent_person`` (records
    were there, none of the person named) and ``empty``.

    Normal questions: dense and BM25 branches under the filters (without them for queries that then have no hit),
    fused, deduplicated, boosted by hints and names, gated to a named person, reranked (``cascade``, ``fast``,
    ``single`` or ``none``), cut by threshold and budget, with the window around a chunk for its text if ``expand``.
    """
    asked = materialize(understand(queries), "asked")
    chat = asked.filter("intent <> 'factual'")
    factual = asked.filter("intent = 'factual'")
    hit = None
    if cache is not None:
        vectors = encode_distinct(factual.select("query_id", F.col("effective").alias("t"), "applied"), "t", "vector", *([encoder] if encoder else []))
        probe = vectors.select("query_id", "vector", F.to_json("applied").alias("namespace"), F.current_timestamp().alias("ts"))
        hit = materialize(nearest_cached(probe, cache), "cached")
        factual = factual.join(hit, "query_id", "left_anti")
    exact, normal = factual.filter(F.size("literals") > 0), factual.filter(F.size("literals") == 0)
    body = index.chunks.select("id", "doc_id", "source", "category", "district", "topic", "topics", "is_record", "record_name", "record_title", "constituency", "section", F.col("text").alias("chunk_text"), "parent_text")

    first = exact.select("query_id", F.col("literals")[0]["variants"].alias("variants"))
    held = search.literal_hits(index.chunks.select("id", "text"), first, max(20, 4 * k)).join(exact.select("query_id", "literals", "effective"), "query_id").join(body, "id")
    held = held.withColumn("all", holds_all(F.col("literals"), F.col("chunk_text")))
    any_all = F.max(F.col("all").cast("int")).over(Window.partitionBy("query_id"))
    literal_rows = held.withColumn("any", any_all).filter("any = 0 or all").select("query_id", *body.columns, "rank", F.lit("literal").alias("status"), F.lit(False).alias("relaxed"), F.lit(1.0).alias("rrf_score"), F.lit(None).cast("double").alias("dense_score"), F.lit(None).cast("double").alias("rerank_score"), F.lit("dense").alias("retriever"))

    narrow, wide = normal.filter("size(places) > 0 or category is not null"), normal.filter("size(places) = 0 and category is null")
    strict = materialize(fusion.fuse(_branches(index, narrow, True, encoder, K.BRANCH_TOP_K)), "strict")
    missed = narrow.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    loose = fusion.fuse(_branches(index, wide.unionByName(missed), False, encoder, K.BRANCH_TOP_K))
    relaxed = missed.select("query_id", F.lit(True).alias("relaxed"))
    fused = strict.unionByName(loose).join(relaxed, "query_id", "left").withColumn("relaxed", F.coalesce("relaxed", F.lit(False)))
    known = normal.select("query_id", "effective", "places", "category_hint", "topic_hint", "person")
    rows = fused.join(body, "id").join(known, "query_id").withColumn("prefix", T.dedupe_prefix(F.col("chunk_text")))
    unique = fusion.content_dedupe(rows, "doc_id", "prefix").withColumn("f1", F.when(F.col("person").isNotNull(), T.name_f1(F.col("person"), F.col("record_name"))).otherwise(0.0))
    true = lambda c: F.coalesce(c, F.lit(False))
    topical = true((F.col("topic") == F.col("topic_hint")) | F.array_contains("topics", F.col("topic_hint")))
    lifted = fusion.boosted(unique, true(F.col("category") == F.col("category_hint")), topical, true(F.col("district") == F.try_element_at("places", F.lit(1))), F.col("f1"), F.col("is_record"))
    unnamed = fusion.entity_gate(lifted.filter("person is not null")).drop("best_f1").unionByName(lifted.filter("person is null"))
    capped = search.top_k(unnamed, K.CANDIDATE_CAP, score="rrf_score").drop("rank", "prefix")
    ranked = fusion.reranked(capped, mode, fast(F.col("effective"), F.col("chunk_text")), precise(F.col("effective"), F.col("chunk_text")))
    candidates = materialize(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), "id"))), "candidates")

    shown = display_score(F.col("dense_score"))
    passes = F.when(F.col("rerank_score").isNotNull(), F.col("rerank_score") >= K.RERANK_THRESHOLD).otherwise(shown.isNull() | (shown >= K.SIMILARITY_THRESHOLD))
    good = candidates.filter(passes).withColumn("status", F.lit("normal"))
    best = candidates.filter("rank = 1").join(good.select("query_id").distinct(), "query_id", "left_anti")
    floor = K.RERANK_THRESHOLD - K.ABANDON_MARGIN
    lost = F.coalesce(F.col("rerank_score") < floor, F.lit(False))
    effort = best.filter(~lost).withColumn("status", F.lit("best_effort"))
    columns = ["query_id", *body.columns, "rank", "status", "relaxed", "rrf_score", "dense_score", "rerank_score", "retriever"]
    every = materialize(literal_rows.select(*columns).unionByName(good.select(*columns)).unionByName(effort.select(*columns)), "chosen")
    text = F.coalesce("parent_text", "chunk_text") if expand else F.col("chunk_text")
    sized = every.withColumn("text", text).withColumn("length", F.length("text"))
    chosen = fusion.select_budget(sized, "length", k=k).join(sized, ["query_id", "id"])
    lone = F.when(F.col("status") == "best_effort", F.coalesce(F.nullif(display_score(F.col("dense_score")), F.lit(0.0)), "rrf_score"))
    score = F.round(F.coalesce(lone, fusion.final_score(F.col("rerank_score"), F.col("dense_score"), F.col("rrf_score"))), 4)
    hits = chosen.select("query_id", "status", "relaxed", "position", *[c for c in body.columns if c not in ("parent_text", "topics", "topic")], F.expr("substring(text, 1, kept_length)").alias("text"), score.alias("score"), F.round("dense_score", 4).alias("dense_score"), F.round("rrf_score", 6).alias("rrf_score"), F.round("rerank_score", 4).alias("rerank_score"), "retriever")

    gone = unique.filter("person is not null").groupBy("query_id").agg(F.max("f1").alias("f1"), F.max(F.col("is_record").cast("int")).alias("records")).filter((F.col("f1") < K.PERSON_MATCH) & (F.col("records") > 0))
    reasons = best.filter(lost).select("query_id", F.lit("off_topic").alias("why")).unionByName(gone.select("query_id", F.lit("absent_person").alias("why"))).groupBy("query_id").agg(F.min("why").alias("why"))
    none = asked.join(hits.select("query_id").distinct(), "query_id", "left_anti").join(reasons, "query_id", "left")
    if hit is not None:
        hits = hits.unionByName(hit.select("query_id", F.lit("cached").alias("status"), F.col("entry_id").alias("id"), F.col("similarity").alias("score")), allowMissingColumns=True)
        none = none.join(hit, "query_id", "left_anti")
    reason = F.when(F.col("intent") != "factual", "small_talk").when(F.size("literals") > 0, "literal_miss").otherwise(F.coalesce("why", F.lit("empty")))
    return hits.unionByName(none.select("query_id", reason.alias("status")), allowMissingColumns=True)


def answer(index: Index, queries: DataFrame, **options) -> DataFrame:
    """``query_id, status, answer, grounded, context, citations``: an extract of the best chunk with its citations, a reply or a refusal.

    Citations are resolved from the markers in the answer; an answer is grounded if at least one is. A question about
    a person of whom no record was found is refused by name.
    """
    asked = materialize(understand(queries).select("query_id", "text", "intent", "effective", "person"), "asked")
    hits = materialize(retrieve(index, queries, **options), "hits")
    rows = hits.filter("position is not null")
    headed = rows.select("query_id", "position", answers.source_header(rows).alias("header"), F.col("text").alias("body"))
    context = answers.context_block(headed)
    drawn = answers.extractive(rows.join(asked.select("query_id", F.col("effective").alias("question"), "person"), "query_id"))
    cited = answers.citations(drawn.select("query_id", "answer"), rows.select("query_id", "position", "id", "doc_id", "source", F.col("score"), T.snippet(F.col("chunk_text")).alias("snippet")))
    listed = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("use", "position", "id", "doc_id", "source", "snippet"))), lambda c: c.dropFields("use")).alias("citations"))
    status = hits.groupBy("query_id").agg(F.min("status").alias("status"))
    known = asked.join(status, "query_id").join(drawn, "query_id", "left").join(context.select("query_id", "context"), "query_id", "left").join(listed, "query_id", "left")
    chat = reply_of(F.col("intent"), F.col("query_id"), REPLIES)
    text = F.coalesce("answer", F.when(F.col("intent") != "factual", chat), answers.refusal(F.when(F.col("status") == "absent_person", F.col("person"))))
    grounded = (F.col("intent") != "factual") | (F.coalesce(F.size("citations"), F.lit(0)) > 0)
    return known.select("query_id", "status", text.alias("answer"), grounded.alias("grounded"), "context", "citations")
