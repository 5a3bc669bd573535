"""Work that must grow no faster than the input: one pass where several passes or a row against every other stood before."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from orevein import registry
from orevein.functions import chunking as C
from orevein.functions import places as P
from orevein.functions import signals as G
from orevein.functions.text import longest_of
from tests.conftest import SF_DIR


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_looked_for_once_a_text(spark):
    plan = plan_of(registry.queries()["doc_places"](spark, SF_DIR))
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["doc_topics", "doc_category", "doc_party", "document_metadata"])
def test_signals_are_counted_together(spark, name):
    """Not by one replaced copy of the text for every signal."""
    assert not re.search(r"(?<!_)replace\(", plan_of(registry.queries()[name](spark, SF_DIR)))


def test_the_longest_word_is_found_as_among_alternatives():
    rng = random.Random(5)
    words = sorted(P.ALIASES)
    slow, fast = re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, P.LONGEST_FIRST)) + r")\b"), re.compile(P.PATTERN)
    for _ in range(300):
        text = "".join(rng.choice([*words, w[: rng.randrange(len(w))], w.title(), "dr. b.r. ", "x"]) + rng.choice([" ", ", ", "", " east "]) for w in rng.choices(words, k=20))
        assert slow.findall(text) == fast.findall(text)
    assert re.compile(longest_of(["a", "ab", "abc", "b"])).findall("abcabdab b") == ["abc", "ab", "ab", "b"]


def test_signal_counts_do_not_overlap(spark):
    text = "healthealth transportransport road metro metro, FARMER farmer farmers arogyarogya"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(G.topics(F.col("t"), 14).alias("x")).collect()
    low = text.lower()
    scores = {own: sum(low.count(s) for s in signals) for own, signals in G.TOPICS.items()}
    assert row[0].x == sorted((k for k, n in scores.items() if n), key=lambda k: (-scores[k], list(scores).index(k))) and row[1].x == []


def test_records_of_a_long_text_in_time_with_its_length():
    record = "Dr. Asha Rao {0} - North Hill, Place District\nBorn. 3 May 1950, in Place.\nProfession. Farmer.\nLanguages. Telugu, Ashaish.\n\n"
    began = time.perf_counter()
    found = C.split_records("".join(record.format(i) for i in range(20_000)))
    assert len(found) == 20_000 and all(len(r["labels"]) == 3 for r in found)
    assert time.perf_counter() - began < 20  # some 100,000 lines; counting labels once a line took minutes


def _ranked(rows):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in rows)


def test_best_by_terms_in_small_blocks_equal_all_scores(spark, monkeypatch):
    """Weights in blocks, buffers cut back often, documents over batches; with keys and without."""
    from orevein.operators import search
    from orevein.operators.text_index import TextIndex

    rng = random.Random(8)
    words = [f"w{i}x" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(400)], "id long, text string")
    queries = spark.createDataFrame([(i, rng.choices(words, k=4), [f"k{i % 3}", f"k{i % 5}"]) for i in range(60)], "query_id long, terms array<string>, keys array<string>")
    keys = spark.createDataFrame([(i, f"k{j}") for i in range(400) for j in range(5) if i % (j + 2) == 0], "id long, key string")
    index = TextIndex.build(docs)
    every = search.bm25_scores(index, queries).withColumn("score", F.round("score", 9))
    for name, value in (("WEIGHT_ROWS", 150), ("CELLS", 50), ("BUFFER", 10)):
        monkeypatch.setattr(search, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _ranked(search.bm25_topk(index, queries, 5, digits=9).collect()) == _ranked(search.top_k(every, 5).collect())
        fits = every.join(keys, "id").join(queries.select("query_id", "keys"), "query_id").filter(F.array_contains("keys", F.col("key"))).select("query_id", "id", "score").distinct()
        assert _ranked(search.bm25_topk(index, queries, 5, keys=keys, digits=9).collect()) == _ranked(search.top_k(fits, 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_of_a_query_and_a_document_are_not_shuffled(spark):
    from orevein.operators import search
    from orevein.operators.text_index import TextIndex

    index = TextIndex.build(spark.createDataFrame([(1, "a road"), (1, "a plan of roads"), (2, ""), (3, None)], "id long, text string"))
    assert sorted(map(tuple, index.lengths.collect())) == [(1, 3), (2, 0), (3, 0)]
    assert sorted(map(tuple, index.postings.collect())) == [("plan", 1, 1, 3), ("road", 1, 2, 3)]
    plan = plan_of(search.bm25_topk(index, spark.createDataFrame([(7, ["road"])], "query_id long, terms array<string>")))
    assert "MapInArrow" in plan and "HashAggregate" not in plan


def test_a_record_is_parsed_once(spark):
    from orevein.operators import answer

    plan = plan_of(registry.queries()["parse_record"](spark, SF_DIR))
    assert plan.count("regexp_extract(") == len(answer.RECORD_FIELDS) and "hashpartitioning(c_custkey" in plan
    assert plan_of(registry.queries()["record_answers"](spark, SF_DIR)).count("RLIKE") < 20


def test_letter_cues_need_no_window(spark):
    plan = plan_of(registry.queries()["letter_cues"](spark, SF_DIR))
    assert "Window" not in plan and "Exchange" not in plan
