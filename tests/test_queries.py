"""Every query of the core engine against its SQL."""

from __future__ import annotations

import pytest

from orevein import registry
from orevein.plans import composed
from tests.conftest import rows_of, sql_rows

WITH_SQL = sorted(registry.oracle_sql())
WITHOUT_SQL = sorted(set(registry.queries()) - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert rows_of(registry.queries()[name](spark, sf_dir)) == sql_rows(duck, registry.oracle_sql()[name])


TESTED = {
    "answer_cache_replay", "cache_replay", "debounce_partials", "document_chunks", "extract_literals", "extractive_sentences", "hashed_embeddings", "html_blocks",
    "markdown_blocks", "person_extract", "recursive_chunks", "sentence_split", "speculation_stats", "table_split",
}


def test_every_query_without_sql_is_held_against_plain_python():
    """In ``test_exact`` or here."""
    assert set(WITHOUT_SQL) == TESTED | {"answer_pipeline", "retrieve_pipeline", "ingest_chunks", "cache_stats", "hashed_sparse", "records"}


def test_hits_and_answers_of_the_library(spark, sf_dir):
    hits = registry.queries()["retrieve_pipeline"](spark, sf_dir).collect()
    asked = {r.query_id for r in hits}
    rows = registry.queries()["answer_pipeline"](spark, sf_dir).collect()
    assert len(rows) == len({r.query_id for r in rows}) and {r.query_id for r in rows} == asked
    for r in hits:
        assert (r.position is None) == (r.status in ("small_talk", "literal_miss", "off_topic", "absent_person", "empty"))
    for r in rows:
        assert r.grounded == (r.status == "small_talk" or bool(r.citations)) and (not r.citations or "[1]" in r.answer)


def test_chunks_of_the_library(spark, sf_dir):
    rows = registry.queries()["ingest_chunks"](spark, sf_dir).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) and all(r.text and (r.parent_text is None or not r.is_record) for r in rows)
    assert {r.doc_id >= 1_000_000 for r in rows if r.is_record} == {True}


def test_records_of_books(spark, sf_dir, duck):
    rows = registry.queries()["records"](spark, sf_dir).collect()
    named = [(r[0], r[1]) for r in duck.execute(f"WITH {composed.PROFILES} SELECT nation, title || ' ' || given || ' ' || family FROM profiles").fetchall()]
    assert sorted((r.doc_id, r.name) for r in rows) == sorted(named) and all(len(r.labels) == 7 for r in rows)


def test_cache_stats_add_up(spark, sf_dir):
    outcomes = [r.outcome for r in registry.queries()["cache_replay"](spark, sf_dir).collect()]
    rows = registry.queries()["cache_stats"](spark, sf_dir).collect()
    for name, kind in (("hits", "hit"), ("misses", "miss"), ("appended", "appended"), ("replaced", "replaced")):
        assert sum(r[name] for r in rows) == outcomes.count(kind)
    assert all(r.hit_rate == round(r.hits / (r.hits + r.misses), 4) for r in rows)
