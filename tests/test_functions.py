"""Unit tables of pure functions, and invariants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orevein.functions import chunking, literals, text
from orevein.functions.models import hashed_embedding
from orevein.functions.vectors import cosine, display_score
from orevein.sources import loaders
from orevein.streaming import speculation

RECORD = "{name} - {seat}, Hill District\n{name} is the candidate for the {seat} assembly constituency in Hill district.\nBorn. {born}\nEducation. Science.\nLanguages. A, B.\n"


def test_terms_strip_one_suffix_after_stop_words(spark):
    rows = spark.createDataFrame([("The parties' Flying flies tested asses x",), (None,), ("",)], "t string")
    out = [r[0] for r in rows.select(text.terms(F.col("t"))).collect()]
    assert out == [["part", "fly", "fli", "test", "ass", "x"], [], []]


def test_display_score_is_not_monotone(spark):
    rows = spark.createDataFrame([(-0.2,), (0.1,), (2.0,)], "d double")
    assert [round(r[0], 2) for r in rows.select(display_score(F.col("d"))).collect()] == [0.4, 0.1, 1.0]


def test_cosine_of_zero_is_zero(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, -1.0]


def test_recursive_split_covers_the_text():
    body = "One two three. " * 100 + "\n\n" + "x" * 2000
    pieces = chunking.split_recursive(body, 300, 40)
    assert all(0 < len(p) <= 300 for p in pieces)
    assert "".join(body.split())[:50] in "".join("".join(pieces).split())
    assert chunking.split_recursive("") == [] and chunking.split_recursive(None) == []


def test_tables_repeat_their_header():
    table = "\n".join(["| a | b |", "|---|---|", *[f"| {i} | {i} |" for i in range(40)]])
    pieces = chunking.split_table(table, 120)
    assert len(pieces) > 1 and all(p.startswith("| a | b |\n|---|---|") for p in pieces)
    assert chunking.split_table("a\nb") == ["a\nb"]


def test_records_split_at_titles():
    body = "\n".join(RECORD.format(name=n, seat=s, born=b) for n, s, b in (("Dr. Asha Rao", "North", "1970"), ("Smt. Mina Rao", "South", "1980"), ("Sri Ravi Das", "East", "1990")))
    found = chunking.split_records(body)
    assert [r["name"] for r in found] == ["Dr. Asha Rao", "Smt. Mina Rao", "Sri Ravi Das"]
    assert [r["seat"] for r in found] == ["North", "South", "East"]
    assert chunking.split_records("Just prose. Nothing else.") == []


def test_literals_prefer_the_specific():
    assert [x["kind"] for x in literals.find_literals("12 percent in 1999 on 14/10/1985")] == ["date", "percent"]
    assert literals.find_literals("12% and 3") == []  # a percent sign is followed by no word edge
    assert literals.find_literals(None) == []


def test_html_and_markdown_blocks():
    blocks = loaders.html_blocks("<h2>T</h2><p>a<script>x</script> b</p><ul><li>c</li></ul>")
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "T"), ("paragraph", "a b"), ("list_item", "c")]
    blocks = loaders.markdown_blocks("# A\ntext\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n- item\n```\ncode # no\n```\nB\n===")
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "table", "list_item", "paragraph", "heading"]
    assert loaders.render_table([["a", ""], ["", ""]]) == ""


def test_documents_load_from_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# H\n\ntext")
    (tmp_path / "b.csv").write_text("x,y\n1,\n,\n")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.docx").write_bytes(b"broken")
    rows = {r.source: r for r in loaders.load_documents(spark, str(tmp_path)).collect()}
    assert [b.kind for b in rows["a.md"].blocks] == ["heading", "paragraph"]
    assert [b.text for b in rows["b.csv"].blocks] == ["x: 1"]
    assert "unsupported" in rows["c.bin"].error and rows["d.docx"].error


def test_embedding_is_unit_or_zero(spark):
    rows = spark.createDataFrame([("alpha beta alpha",), ("the of",), (None,)], "t string").select(hashed_embedding(F.col("t")).alias("v")).collect()
    assert [round(sum(x * x for x in r.v), 6) for r in rows] == [1.0, 0.0, 0.0]


def test_debounce_counts_from_the_last_fired():
    s = speculation.Speculation()
    assert [e[0] for e in s.partial(0, "what is the plan", [1, 0])] == ["fired"]
    assert [e[0] for e in s.partial(100, "what is the plan for", [1, 0])] == ["skipped"]
    assert [e[0] for e in s.partial(190, "what is the plan for roads", [1, 0])] == ["fired"]
    assert [e[0] for e in s.final(1000, "what is the plan for roads", [1, 0.01])] == ["reused"]
    assert [e[0] for e in s.final(2000, "x", [1, 0])] == ["fresh"]
    assert not speculation.stable("what is the pla-") and not speculation.stable("ab cd")


def test_speculation_stream(spark, tmp_path):
    source = tmp_path / "in"
    base = dt.datetime(2024, 1, 1)
    rows = [("s1", base + dt.timedelta(milliseconds=ms), kind, t, [1.0, 0.0]) for ms, kind, t in ((0, "partial", "what is the plan"), (100, "partial", "what is the plan now"), (400, "partial", "what is the plan for roads"), (900, "final", "what is the plan for roads"))]
    schema = "session_id string, ts timestamp, kind string, text string, embedding array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    events = speculation.speculate(spark.readStream.schema(schema).parquet(str(source)), ttl_s=None)
    events.writeStream.format("memory").queryName("spec").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r.event for r in spark.table("spec").orderBy("ts").collect()] == ["fired", "skipped", "fired", "reused"]


def test_windowed_metrics_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 30, 3)], "key string, ts timestamp, value_ms double").write.parquet(str(source))
    out = speculation.metrics(spark.readStream.schema("key string, ts timestamp, value_ms double").parquet(str(source)))
    out.writeStream.format("memory").queryName("m").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.n for r in spark.table("m").collect()) == 10


def test_sentences_leave_when_the_next_begins():
    assert speculation.emitted_sentences(["One. Tw", "o! Thr", "ee"]) == ["One.", "Two!", "Three"]


def test_upsert_is_idempotent(spark):
    from orevein.operators.memory import upsert

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    once = upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, new).collect())) == [(1, "a"), (2, "d"), (3, "e")]




def test_hashed_counts_take_every_term(spark, sf_dir):
    from orevein.functions import entities
    from orevein.plans.entity_queries import hashed_sparse
    from orevein.session import load

    docs = load(spark, sf_dir, "documents").select("doc_id", text.terms(F.col("text")).alias("terms"))
    found = {r.doc_id: r.terms for r in docs.collect()}
    each = spark.createDataFrame([(t,) for t in {t for ts in found.values() for t in ts}], "t string")
    slot = dict(each.select("t", F.pmod(F.xxhash64("t"), F.lit(65536))).collect())
    assert {r.doc_id: r.n for r in hashed_sparse(spark, sf_dir).collect()} == {i: len({slot[t] for t in ts}) for i, ts in found.items()}
    few = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (2, []), (3, None)], "doc_id long, terms array<string>")
    out = entities.hashed_counts(few).collect()
    assert sorted((r.doc_id, sorted(r.counts.values())) for r in out) == [(1, [1]), (1, [1, 2]), (2, []), (3, [])]
