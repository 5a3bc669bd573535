"""Queries without SQL against plain Python over the same rows, and the entry points on tables whose answers are known."""

from __future__ import annotations

import datetime as dt
import html.parser
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orevein import registry
from orevein.functions import chunking, judges, literals, models, places, rewrite, signals
from orevein.functions import constants as K
from orevein.operators import answer, caches, memory, search
from orevein.operators.text_index import TextIndex
from orevein.plans import composed, retrieval
from orevein.session import load
from orevein.sources import loaders, pdf
from orevein.streaming import speculation


def table(spark, sf_dir, name, *columns):
    return [tuple(r) for r in load(spark, sf_dir, name).select(*columns).collect()]


def found(spark, sf_dir, name, *columns):
    return Counter(tuple(r) for r in registry.queries()[name](spark, sf_dir).select(*columns).collect())


# --- splitting
def test_sentence_split(spark, sf_dir):
    expected = Counter()
    for i, text in table(spark, sf_dir, "documents", "doc_id", "text"):
        out = []
        for s in re.split(r"(?<=[.!?।])[ \t\n\x0b\f\r]+", text or ""):
            s = s.strip(" \t\n\x0b\f\r")
            if s:
                out[-1:] = [f"{out[-1]} {s}"] if out and len(out[-1]) < 40 else [*out[-1:], s]
        expected.update((i, k, s) for k, s in enumerate(out))
    assert found(spark, sf_dir, "sentence_split", "doc_id", "pos", "sentence") == expected


def plain_split(text, size, overlap, seps):
    """The splitting by the rules: find the first separator in the text, fill pieces, lead each by the end of the last."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(seps):
        if sep in text:
            break
    else:
        return [text[i : i + size] for i in range(0, len(text), size - overlap)]
    pieces, buffer = [], ""
    for part in text.split(sep):
        if not part.strip():
            continue
        if buffer and len(buffer + sep + part) <= size or not buffer and len(part) <= size:
            buffer = buffer + sep + part if buffer else part
            continue
        if buffer:
            pieces.append(buffer.strip())
        tail = buffer[-overlap:] if len(buffer) > overlap else ""
        if tail:
            ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z(\"'ఀ-౿])", tail)]
            if ends and len(tail) - ends[0] > 0.3 * overlap:
                tail = tail[ends[0] :]
            elif " " in tail:
                tail = tail[tail.index(" ") + 1 :]
        if len(part) > size:
            pieces += plain_split(part, size, overlap, seps[k + 1 :])
            buffer = ""
        else:
            buffer = tail + sep + part if tail and len(tail + sep + part) <= size else part
    return pieces + ([buffer.strip()] if buffer.strip() else [])


def test_recursive_chunks(spark, sf_dir):
    expected = Counter()
    for i, text in table(spark, sf_dir, "documents", "doc_id", "text"):
        expected.update((i, k, p) for k, p in enumerate(plain_split(text or "", 700, 120, ["\n\n", "\n", ". ", "; ", ", ", " "])))
    assert found(spark, sf_dir, "recursive_chunks", "doc_id", "pos", "piece") == expected


def test_table_split(spark, sf_dir):
    expected = Counter()
    for i, text in table(spark, sf_dir, "documents", "doc_id", "text"):
        rows = [x for x in (text or "").split("\n") if x.strip()]
        if len(rows) <= 2:
            pieces = [text or ""]
        else:
            head = rows[:2] if set(rows[1]) <= set(" \t|:-") else rows[:1]
            pieces, own = [], []
            for row in rows[len(head) :]:
                if own and len("\n".join(head + own + [row])) > 700:
                    pieces.append("\n".join(head + own))
                    own = []
                own.append(row)
            pieces += ["\n".join(head + own)] if own else []
        expected.update((i, k, p) for k, p in enumerate(pieces))
    assert found(spark, sf_dir, "table_split", "doc_id", "pos", "piece") == expected


class Flat(html.parser.HTMLParser):
    """Texts between tags that end a block, without scripts and styles."""

    ENDS = {"p", "li", "div", "td", "th", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.parts += [""] if tag in self.ENDS else []

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        self.parts += [""] if tag in self.ENDS else []

    def handle_data(self, data):
        self.parts[-1] += "" if self.hidden else data


def test_html_blocks(spark, sf_dir):
    expected = Counter()
    for i, page in table(spark, sf_dir, "pages", "page_id", "html"):
        flat = Flat()
        flat.feed(page or "")
        flat.close()
        texts = [" ".join(p.split()) for p in flat.parts]
        expected.update((i, k, t) for k, t in enumerate(t for t in texts if t))
    assert found(spark, sf_dir, "html_blocks", "page_id", "pos", "text") == expected


def test_markdown_blocks_hold_all_words_in_order(spark, sf_dir):
    texts = dict(table(spark, sf_dir, "documents", "doc_id", "text"))
    blocks = defaultdict(list)
    for r in registry.queries()["markdown_blocks"](spark, sf_dir).orderBy("doc_id", "pos").collect():
        blocks[r.doc_id].append(r)
    for i, text in texts.items():
        if not re.search(r"(?m)^#{1,6}\s+\S", text or ""):
            parts = [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]
            heading = [("\n" not in p and len(p) <= 90 and (p.isupper() or p.endswith(":"))) for p in parts]
            assert [(b.text, b.kind) for b in blocks[i]] == [(p.rstrip(":") if h else p, "heading" if h else "paragraph") for p, h in zip(parts, heading, strict=True)]
        else:
            assert re.findall(r"\w+", " ".join(b.text for b in blocks[i])) == re.findall(r"\w+", re.sub(r"(?m)^\s*\d+[.)]\s", "", text))


def test_chunks_lie_in_their_documents(spark, sf_dir):
    texts = dict(table(spark, sf_dir, "documents", "doc_id", "text"))
    rows = registry.queries()["document_chunks"](spark, sf_dir).collect()
    per = Counter(r.doc_id for r in rows)
    squash = lambda t: re.sub(r"\W+", "", t)
    for r in rows:
        assert r.total_chunks == per[r.doc_id] and r.chunk_id == f"{r.doc_id}-{r.chunk_index:04d}"
        assert len(r.text) <= 700 * 1.3 and (r.section or len(r.text) >= 80)
        if len(r.text) >= 160:
            assert r.text[:40] == texts[r.doc_id][r.char_start : r.char_start + 40] or squash(r.text[:30]) in squash(texts[r.doc_id])
        assert r.parent_text is None or len(r.parent_text) > len(r.text) + 80
    long = {i for i, t in texts.items() if len(t or "") > 200}
    assert long <= set(per)


# --- understanding
def plain_literals(text):
    """Values by the rules, with the spans of stronger kinds struck out first."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    dmy = [m for m in re.finditer(rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:{months})\.?\s*,?\s*\d{{4}}\b", text) if 1 <= int(m[1]) <= 31]
    mdy = [m for m in re.finditer(rf"(?i)\b(?:{months})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*\d{{4}}\b", text) if 1 <= int(m[1]) <= 31]
    out, taken = [("date", m[0], 5) for m in dmy + mdy], [m.span() for m in dmy + mdy]

    def add(kind, pattern, weight, group=0, fits=lambda m: True):
        for m in re.finditer(pattern, text):
            if fits(m) and not any(m.start() < b and a < m.end() for a, b in taken):
                out.append((kind, m[group].strip(), weight))
                taken.append(m.span())

    add("date", r"\b(\d{1,4})[/-](\d{1,2})[/-](\d{2,4})\b", 5, 0, lambda m: 1 <= int(m[2]) <= 12 and 1 <= int(m[3] if len(m[1]) == 4 else m[1]) <= 31)
    add("money", r"(?i)\b(?:rs\.?|rupees|inr)?\s*(\d+(?:\.\d+)?)\s*(lakhs?|crores?)\b", 4)
    add("percent", r"(?i)\b(\d{1,3}(?:\.\d+)?)\s*(?:percent|per cent|%)\b", 3)
    add("decimal", r"\b(\d+\.\d+)\b", 3)
    for m in re.finditer(r"\b(?:candidates?|nominee|mla|contesting|standing|represent(?:ing|s)?)\s+(?:is\s+)?(?:for|from|in)\s+(?:the\s+)?([A-Z][\w'’.-]*(?:\s+[A-Z][\w'’.-]*){0,3})(\s+(?:assembly|constituency|seat|district|mandal))?", text):
        if (m[2] or "").strip() not in ("district", "mandal") and not any(m.start() < b and a < m.end() for a, b in taken):
            out.append(("seat", m[1].strip(" .,"), 4))
    out = out or [("year", y, 1) for y in re.findall(r"\b(1[89]\d{2}|20[0-4]\d)\b", text)]
    return ", ".join(f"{k}:{r}" for k, r, _ in sorted(out, key=lambda x: -x[2])) or "none"


def test_extract_literals(spark, sf_dir):
    expected = Counter((r.id, plain_literals(r.text)) for r in composed.utterances(spark, sf_dir).collect())
    out = found(spark, sf_dir, "extract_literals", "id", "found")
    assert out == expected and len({f for _, f in out}) > 3
    for text in composed.UTTERANCES:
        assert ", ".join(f"{x['kind']}:{x['raw']}" for x in literals.find_literals(text)) == plain_literals(text).removeprefix("none")
    assert literals.date_spellings(4, 3, literals._in_full("99")) == ["4 March 1999", "04 March 1999", "March 4, 1999", "4/3/1999", "04/03/1999", "1999-03-04"]
    assert [literals._in_full(y) for y in ("00", "49", "50", "1985")] == ["2000", "2049", "1950", "1985"] and literals.date_spellings(32, 1, "1999") == []


def test_person_extract(spark, sf_dir):
    known = {
        "What are the assets of Dr. Asha Rao's family": "Asha Rao", "tell me about Ravi Kumar Gupta": "Ravi Kumar Gupta", "who stands for Guntur West": None, "is Meena Das from Hill Town": "Meena Das",
        "which languages does Nagesh speak": None, "rythu bharosa, amma vodi and pension in Guntur or Tenali": None, "hello": None,
    }
    texts = {r.id: r.text for r in composed.utterances(spark, sf_dir).collect()}
    out = dict(found(spark, sf_dir, "person_extract", "id", "person"))
    seen = {texts[i]: p for i, p in out if texts[i] in known}
    assert seen == {t: p for t, p in known.items() if t in seen} and len(seen) >= 5


def test_small_words_of_understanding(spark):
    rows = spark.createDataFrame([(1, "Um, please tell me the road plan"), (2, "hi"), (3, "well, kind of current bills"), (4, "job openings, actually")], "id int, q string")
    assert [r[0] for r in rows.orderBy("id").select(rewrite.cleaned(F.col("q"))).collect()] == ["please tell me the road plan", "hi", "current bills", "job openings"]
    got = [r[0] for r in rows.orderBy("id").select(rewrite.expansions(F.col("q"), F.lit("Guntur"))).collect()]
    assert got[0] == ["Um, please tell me the road plan roads infrastructure", "Um, please tell me the road plan Guntur district"] and got[3][0].endswith("employment recruitment")
    told = spark.createDataFrame([("\"Road plan\nmore\"",), ("I cannot say",), ("",), (None,), ("w " * 41,)], "t string")
    assert [r[0] for r in told.select(rewrite.accepted_rewrite(F.col("t"))).collect()] == ["Road plan", None, None, None, None]


def test_places_and_signals(spark):
    rows = spark.createDataFrame([(1, "I'm from Tenali, not Ongole. Ongole!", ""), (2, None, "faq.md"), (3, "Q1. a\nQ2. b\nQ3. c", "x")], "id int, t string, f string")
    out = rows.orderBy("id").select(places.places(F.col("t")).alias("p"), places.stated_place(F.col("t")).alias("s"), signals.category(F.col("t"), F.col("f")).alias("c"), signals.topics(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in out] == [(["Prakasam", "Guntur"], "Prakasam", "other", []), ([], None, "faq", []), ([], None, "faq", [])]
    assert len(places.GAZETTEER) == 35 and places.ALIASES["kadiri"] == "Sri Sathya Sai" and places.ALIASES["nandyal"] == "Nandyal"


# --- caches and streams
def plain_cache(requests, threshold, replace, size, ttl):
    """One cache by the rules, a list scanned for every request."""
    entries, out = [], []
    for ts, seq, op, space, v, name in requests:
        length = sum(x * x for x in v) ** 0.5
        unit = [x / length for x in v]
        if op == "get":
            entries = [e for e in entries if e[0] != space or ts - e[2] <= ttl]
        likes = [(sum(a * b for a, b in zip(e[1], unit, strict=True)), -i) for i, e in enumerate(entries) if e[0] == space]
        best = max(likes, default=(-2, 0))
        if op == "get":
            out.append((seq, "hit" if best[0] >= threshold else "miss", entries[-best[1]][3] if best[0] >= threshold else None, len(entries)))
            continue
        if best[0] >= replace:
            entries[-best[1]] = (space, unit, ts, name)
            out.append((seq, "replaced", name, len(entries)))
            continue
        entries.append((space, unit, ts, name))
        entries = sorted(entries, key=lambda e: e[2])[-size:] if len(entries) > size else entries
        out.append((seq, "appended", name, len(entries)))
    return out


@pytest.mark.parametrize("name,settings", [("cache_replay", caches.RETRIEVAL), ("answer_cache_replay", caches.ANSWERS)])
def test_cache_replay(spark, sf_dir, name, settings):
    rows = defaultdict(list)
    for i, v, label in table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"):
        at = 1_700_000_000 + i
        rows[f"c{i % 4}"] += [(at, 2 * i, "get", str(label), v, str(i)), (at, 2 * i + 1, "put", str(label), v, str(i))]
    expected = Counter()
    for cache, own in rows.items():
        expected.update((cache, *x) for x in plain_cache(sorted(own), settings.threshold, settings.replace, settings.size, settings.ttl_s))
    out = registry.queries()[name](spark, sf_dir).collect()
    assert Counter((r.cache, r.seq, r.outcome, r.query, r.entries) for r in out) == expected


def test_cache_limits(spark):
    base = dt.datetime(2024, 1, 1)
    unit = lambda k: [1.0 if i == k else 0.0 for i in range(8)]
    puts = [("c", base + dt.timedelta(seconds=k), k, "put", "n", unit(k), f"q{k}", "v") for k in range(5)]
    rows = [*puts, ("c", base + dt.timedelta(seconds=6), 6, "get", "n", unit(0), None, None), ("c", base + dt.timedelta(seconds=7), 7, "get", "n", unit(4), None, None), ("c", base + dt.timedelta(seconds=8), 8, "put", "n", [0.0] * 8, "z", "z"), ("c", base + dt.timedelta(seconds=9), 9, "get", "other", unit(4), None, None), ("c", base + dt.timedelta(seconds=2000), 10, "get", "n", unit(4), None, None), ("c", base + dt.timedelta(seconds=2001), 11, "invalidate", None, None, None, None)]
    frame = spark.createDataFrame(rows, "cache string, ts timestamp, seq long, op string, namespace string, vector array<double>, query string, value string")
    out = caches.replay(frame, caches.Settings(size=3))
    assert [(r.seq, r.outcome, r.entries) for r in out.orderBy("seq").collect()] == [(0, "appended", 1), (1, "appended", 2), (2, "appended", 3), (3, "appended", 3), (4, "appended", 3), (6, "miss", 3), (7, "hit", 3), (8, "ignored", 3), (9, "miss", 3), (10, "miss", 0), (11, "invalidated", 0)]
    s = caches.stats(out).first()
    assert (s.hits, s.misses, s.hit_rate, s.appended, s.evicted, s.generation, s.entries) == (1, 3, 0.25, 5, 2, 1, 0)


def test_speculation_events(spark, sf_dir):
    turns = defaultdict(list)
    for c, t, role, text in table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"):
        if role == "user":
            turns[str(c)].append((t, text))
    vectors = {r.t: r.v for r in spark.createDataFrame([(x,) for own in turns.values() for _, x in own], "t string").distinct().select("t", models.hashed_embedding(F.col("t")).alias("v")).collect()}
    expected = Counter()
    for session, own in turns.items():
        own.sort()
        fired, kept = None, []
        for t, text in own[:-1]:
            ms = t * 100
            fits = len(text.strip()) >= 12 and sum(len(w) > 1 for w in text.split()) >= 3 and not text.strip().endswith("-")
            if not fits or (fired is not None and ms - fired < 180):
                expected[(session, "skipped", text)] += 1
                continue
            if kept and kept[-1][0] + 150 > ms:
                expected[(session, "cancelled", kept[-1][1])] += 1
                kept = kept[:-1]
            fired, kept = ms, [*kept[-3:], (ms, text)]
            expected[(session, "fired", text)] += 1
        ms, text = own[-1][0] * 100, own[-1][1]
        like = sorted(((m + 150 <= ms, float(np.dot(vectors[x], vectors[text])), x) for m, x in kept), reverse=True)
        near = [x for x in like if x[1] >= 0.94]
        if near:
            expected[(session, "reused", near[0][2])] += 1
        else:
            expected.update([(session, "discarded", like[0][2])] if like else [])
            expected[(session, "fresh", text)] += 1
    assert found(spark, sf_dir, "debounce_partials", "session_id", "event", "text") == expected
    total = Counter()
    for (_, event, _), n in expected.items():
        total[event] += n
    s = registry.queries()["speculation_stats"](spark, sf_dir).agg(*[F.sum(x).alias(x) for x in ("fired", "cancelled", "reused", "discarded", "skipped")]).first()
    assert [s[x] for x in ("fired", "cancelled", "reused", "discarded", "skipped")] == [total[x] for x in ("fired", "cancelled", "reused", "discarded", "skipped")]


def test_reset_and_sentences():
    s = speculation.Speculation()
    s.event("partial", 0, "what is the plan", [1, 0])
    assert [e[0] for e in s.event("reset", 100, "", None)] == ["cancelled", "reset"] and s.runs == [] and s.last is None
    assert speculation.split_off("One", ". Two") == (["One."], "Two")


def test_sentence_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("u1", base, 0, "One. Tw", False), ("u1", base, 1, "o! Thr", False), ("u1", base, 2, "ee", True), ("u2", base, 0, "Alone", True)]
    schema = "utterance_id string, ts timestamp, seq long, piece string, done boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = speculation.sentences_as_they_end(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ttl_s=None)
    out.writeStream.format("memory").queryName("sents").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert Counter((r.utterance_id, r.sentence) for r in spark.table("sents").collect()) == Counter([("u1", "One."), ("u1", "Two!"), ("u1", "Three"), ("u2", "Alone")])


# --- models and judges
def test_hashed_embeddings(spark, sf_dir):
    terms = {r.doc_id: r.terms.split(" ") if r.terms else [] for r in registry.queries()["tokenize_terms"](spark, sf_dir).collect()}
    for r in registry.queries()["hashed_embeddings"](spark, sf_dir).collect():
        v = [0.0] * models.DIM
        for t in terms[r.doc_id]:
            h = zlib.crc32(t.encode())
            v[h % models.DIM] += 1 if (h >> 16) & 1 else -1
        length = sum(x * x for x in v) ** 0.5 or 1.0
        assert r.vector == pytest.approx([x / length for x in v])


def test_extractive_sentences(spark, sf_dir):
    docs, items = dict(table(spark, sf_dir, "documents", "doc_id", "text")), dict(table(spark, sf_dir, "benchmark", "item_id", "text"))
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in K.ANSWER_STOP_WORDS}
    expected = set()
    for i, question in items.items():
        if i not in docs:
            continue
        every = [p.strip() for p in re.split(r"(?<=[.!?।])\s+", docs[i]) if p.strip()]
        ranked = sorted(range(len(every)), key=lambda k: (-len(words(question) & words(every[k])), k))[:2]
        good = [k for k in ranked if words(question) & words(every[k]) or not words(question)] or ranked[:1]
        expected.add((i, " ".join(every[k] for k in sorted({*good, ranked[0]}))))
    assert set(found(spark, sf_dir, "extractive_sentences", "id", "answer")) == expected


def test_generation_fails_by_row(spark):
    def client():
        def complete(turn):
            if "bad" in turn:
                raise TimeoutError("slow")
            return "" if "empty" in turn else f"said {turn}"

        return complete

    turns = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "empty")], "query_id long, turn string")
    made = models.generate(turns, client)
    assert {r.query_id: (r.text, r.failed, r.note) for r in made.collect()} == {1: ("said a", False, None), 2: (None, True, "TimeoutError: slow"), 3: ("", True, "empty text")}
    drawn = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, answer string")
    assert {r.query_id: (r.answer, r.model) for r in models.generated_or(drawn, made).collect()} == {1: ("said a", "generated"), 2: ("y", "extractive")}


def test_registered_functions(spark):
    assert models.register_functions(spark) == ["described_literals", "named_person", "states_value"]
    row = spark.sql("SELECT named_person('about Ravi Kumar Gupta') p, described_literals('in 1999') l, states_value('forty-three lakh and ten', '43.1') v").first()
    assert tuple(row) == ("Ravi Kumar Gupta", "year:1999", True)


def test_judges():
    assert [judges.spelled(n) for n in (0, 13, 20, 43, 99)] == ["zero", "thirteen", "twenty", "forty-three", "ninety-nine"]
    assert judges.states("Born October 14, 1985", "14 October 1985") and not judges.states("Born October 14, 1986", "14 October 1985")
    assert judges.states("the water supply for hills", "Water supply in the hills") and not judges.states("nothing", "Water supply") and not judges.states("x", "5.5")


# --- indexes and the entry points
def test_text_index_is_kept_up(spark, tmp_path):
    docs = spark.createDataFrame([(1, "road plan road"), (2, "the of"), (3, None), (4, "water plans")], "id long, text string")
    rows = lambda i: (Counter(map(tuple, i.postings.collect())), Counter(map(tuple, i.lengths.collect())))
    index = TextIndex.build(docs)
    assert rows(index) == (Counter([("road", 1, 2, 3), ("plan", 1, 1, 3), ("water", 4, 1, 2), ("plan", 4, 1, 2)]), Counter([(1, 3), (2, 0), (3, 0), (4, 2)]))
    assert tuple(index.stats.first()) == (4, 1.25)
    more = spark.createDataFrame([(4, "bridge"), (5, "road")], "id long, text string")
    both = index.add(more)
    assert rows(both) == rows(TextIndex.build(docs.filter("id < 4").union(more)))
    assert rows(both.remove(more.select("id"))) == rows(TextIndex.build(docs.filter("id < 4"))) == rows(both.remove_by(F.col("id") >= 4))
    assert rows(index.clear()) == (Counter(), Counter())
    index.save(str(tmp_path / "i"))
    assert rows(TextIndex.load(spark, str(tmp_path / "i"))) == rows(index) == rows(TextIndex.load(spark, str(tmp_path / "none"), docs))
    top = search.bm25_topk(index, spark.createDataFrame([(7, ["road", "plan"])], "query_id long, terms array<string>"), 1).collect()
    assert [(r.query_id, r.id) for r in top] == [(7, 1)]


def test_dense_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 0.0], None), (4, None, "a"), (5, [1.0, None], "a"), (6, [1.0, 0.0, 0.0], "a"), (7, [], "a")]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, g string")
    queries = spark.createDataFrame([(10, [1.0, 0.5], "a"), (11, [0.0, 0.0, 1.0], "a"), (12, [1.0], "a"), (2, [1.0, 0.0], "a")], "query_id long, vector array<double>, g string")
    out = search.dense_topk(vectors, queries, 2)
    assert {(r.query_id, r.id) for r in out.collect()} == {(10, 1), (10, 3), (11, 6), (2, 1), (2, 3)}
    assert {(r.query_id, r.id) for r in search.dense_topk(vectors, queries, 5, same="g").collect()} == {(10, 1), (11, 6), (2, 1)}
    assert {(r.query_id, r.id) for r in search.dense_topk(vectors, queries, 5, earlier=True).filter("query_id = 2").collect()} == {(2, 1)}
    assert search.dense_topk(vectors, queries.limit(0)).count() == 0


def people_table(spark):
    names = [("Dr. Asha Rao", "North Hill"), ("Smt. Meena Rao", "South Bank"), ("Sri Ravi Das", "Old Town")]
    text = "Profiles\n\n" + "\n\n".join(f"{n} - {s}, Guntur District\n{n} is the candidate for the {s} assembly constituency in Guntur district.\nBorn. {4 + i} May 19{60 + i}, in Guntur.\nAssets declaration. Movable assets Rs. {70 + i}.4 lakh.\nLanguages. Telugu, Hindi." for i, (n, s) in enumerate(names))
    roads = "# Roads\n\nThe road repair plan covers every district road and all bridges of the coast, and it will be done in two years from now.\n\n## Water\n\nEach village near Ongole gets a water tank and a borewell under the water plan, with pipes to every single house."
    return spark.createDataFrame([(1, text, "profiles.txt"), (2, roads, "manifesto.md"), (3, "", "none.txt")], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def index(spark):
    return retrieval.ingest(people_table(spark))


def ask(spark, *texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id long, text string")


def test_ingest(spark, index):
    rows = {(r.doc_id, r.chunk_index): r for r in index.chunks.collect()}
    assert [rows[(1, k)].record_name for k in range(3)] == ["Dr. Asha Rao", "Smt. Meena Rao", "Sri Ravi Das"]
    assert all(rows[(1, k)].text.startswith(rows[(1, k)].record_name) and rows[(1, k)].parent_text is None and rows[(1, k)].district == "Guntur" for k in range(3))
    assert rows[(1, 0)].constituency == "North Hill" and rows[(2, 0)].category == "manifesto" and rows[(2, 1)].section_path == ["Roads", "Water"]
    assert rows[(2, 1)].district == "Prakasam" and rows[(2, 1)].header == "Prakasam | manifesto | Roads › Water"
    report = {r.doc_id: (r.chunks, r.error) for r in retrieval.ingest_report(people_table(spark), index).collect()}
    assert report == {1: (3, None), 2: (2, None), 3: (0, "no text")}


def test_retrieve_by_kind_of_question(spark, index):
    asked = ask(spark, "hello", "who declared Rs. 71.4 lakh", "who declared Rs. 99.9 lakh", "assets of Dr. Asha Rao", "assets of Dr. Nobody Else", "water tank near Ongole", "road repair plan in Warangal")
    out = defaultdict(list)
    for r in retrieval.retrieve(index, asked).collect():
        out[r.query_id].append(r)
    status = {q: {r.status for r in rows} for q, rows in out.items()}
    assert status[0] == {"small_talk"} and status[1] == {"literal"} and status[2] == {"literal_miss"}
    assert [r.record_name for r in out[1]] == ["Smt. Meena Rao"]
    assert {r.record_name for r in out[3] if r.is_record} == {"Dr. Asha Rao"}
    assert not any(r.is_record for r in out[4])
    assert out[5] and all(r.district == "Prakasam" for r in out[5]) and not any(r.relaxed for r in out[5])
    assert out[6] and all(r.relaxed for r in out[6]) and "road repair" in out[6][0].text
    assert all([r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(1, len(rows) + 1)) for rows in out.values() if rows[0].position)


def test_scorers_decide(spark, index):
    asked = ask(spark, "road repair plan")
    low = lambda q, p: F.lit(-3.0)
    lowest = lambda q, p: F.lit(-9.0)
    weak = retrieval.retrieve(index, asked, mode="single", precise=low).collect()
    assert [r.status for r in weak] == ["best_effort"]
    assert [(r.status, r.position) for r in retrieval.retrieve(index, asked, mode="single", precise=lowest).collect()] == [("off_topic", None)]
    plain = retrieval.retrieve(index, asked, mode="none").collect()
    assert all(r.rerank_score is None for r in plain)
    with pytest.raises(ValueError):
        retrieval.retrieve(index, asked, mode="other")


def test_absent_people_are_refused(spark, index):
    only = index.without(spark.createDataFrame([(2,)], "doc_id long"))
    out = retrieval.answer(only, ask(spark, "assets of Dr. Nobody Else")).first()
    assert out.status == "absent_person" and out.answer == "I don't have a profile for Nobody Else in the documents." and not out.grounded


def test_followups_use_the_last_question(spark, index):
    turns = spark.createDataFrame([("s", 0, "user", "assets of Dr. Asha Rao"), ("s", 1, "assistant", "..."), ("s", 2, "user", "and the languages?")], "session string, turn int, role string, text string")
    rows = memory.with_last_question(turns).filter("role = 'user'").select(F.col("turn").cast("long").alias("query_id"), "text", "last_user")
    out = {r.query_id: r for r in retrieval.understand(rows).collect()}
    assert not out[0].followup and out[2].followup and out[2].person == "Asha Rao" and "regarding: assets Asha Rao" in out[2].effective.replace("Dr. ", "")


def test_answers(spark, index):
    asked = ask(spark, "When was Dr. Asha Rao born?", "What are the assets of Smt. Meena Rao?", "who is the candidate for Old Town, Ravi Das", "road repair plan for bridges", "assets of Dr. Nobody Else", "thank you")
    out = {r.query_id: r for r in retrieval.answer(index, asked).collect()}
    assert out[0].answer == "Dr. Asha Rao was born on 4 May 1960, in Guntur. [1]" and out[0].grounded and out[0].citations[0].source == "profiles.txt"
    assert out[1].answer == "Smt. Meena Rao has declared movable assets Rs. 71.4 lakh. [1]"
    assert "road repair plan" in out[3].answer and out[3].answer.endswith("[1]") and out[3].citations[0].position == 1
    assert not any(n in out[4].answer for n in ("Asha", "Meena", "Ravi")) and out[4].status in ("best_effort", "normal", "absent_person")
    assert out[5].status == "small_talk" and out[5].citations is None


def test_index_round_trip(spark, index, tmp_path):
    path = str(tmp_path / "index")
    index.save(path)
    again = retrieval.open_index(spark, str(tmp_path / "missing"), path)
    assert again.chunks.count() == 5 and again.text.lengths.count() == 5
    assert retrieval.ensure_index(spark, path, models.DIM) is not None and retrieval.ensure_index(spark, path, 3) is None and retrieval.open_index(spark, path) is None
    new = retrieval.ingest(spark.createDataFrame([(2, "A short new text about fishing harbours and aqua farms, long enough to stay as a chunk by itself.", "new.txt")], "doc_id long, text string, source string"))
    both = index.upsert(new)
    assert Counter(r.doc_id for r in both.chunks.collect()) == {1: 3, 2: 1} and both.text.lengths.count() == both.vectors.count() == 4
    assert index.without(spark.createDataFrame([(1,)], "doc_id long")).chunks.count() == 2


def test_cached_questions(spark, index):
    asked = ask(spark, "road repair plan", "water tank near Ongole")
    known = retrieval.understand(asked).select("query_id", "effective", F.to_json("applied").alias("namespace"))
    vectors = models.encode_distinct(known, "effective", "vector").filter("query_id = 0")
    cache = vectors.select(F.lit(77).cast("long").alias("entry_id"), "vector", "namespace", (F.current_timestamp() - F.expr("INTERVAL 1 MINUTE")).alias("created_at"))
    out = {r.query_id: r.status for r in retrieval.retrieve(index, asked, cache=cache).collect()}
    assert out[0] == "cached" and out[1] != "cached"


def test_pages_of_lines(spark):
    blocks = spark.createDataFrame([(1, 0, "a\nb", 1), (1, 1, "c", 2), (2, 0, "", 5)], "doc_id int, pos int, text string, page int")
    assert {tuple(r) for r in chunking.line_pages(blocks).collect()} == {(1, 0, 1), (1, 1, 1), (1, 3, 2), (2, 0, 5)}


def pdf_file(compress: bool) -> bytes:
    content = b"BT /F1 20 Tf 50 750 Td (The Title) Tj ET BT /F2 11 Tf 50 700 Td (First \\(line\\)) Tj 0 -13 Td [(sec) -50 (ond) -300 (line)] TJ 0 -60 Td (- an item) Tj ET"
    stream = zlib.compress(content) if compress else content
    head = b"<< /Length %d %s>>" % (len(stream), b"/Filter /FlateDecode " if compress else b"")
    return b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >> endobj\n2 0 obj " + head + b"\nstream\n" + stream + b"\nendstream endobj\n3 0 obj << /BaseFont /Helvetica-Bold >> endobj\n4 0 obj << /BaseFont /Helvetica >> endobj\n"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_blocks(compress):
    out = pdf.pdf_blocks(pdf_file(compress))
    assert [(b["kind"], b["level"], b["text"], b["page"]) for b in out] == [("heading", 1, "The Title", 1), ("paragraph", 0, "First (line)\nsecond line", 1), ("list_item", 0, "an item", 1)]


def test_partitioned_elements(spark, tmp_path):
    class Element:
        def __init__(self, category, text):
            self.category, self.text = category, text

    assert [(b["kind"], b["text"]) for b in loaders.element_blocks([Element("Title", "T"), Element("ListItem", " a "), Element("Odd", "x"), Element("Table", "")])] == [("heading", "T"), ("list_item", "a"), ("paragraph", "x")]
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.pdf").write_bytes(pdf_file(True))
    taken = loaders.load_documents(spark, str(tmp_path), lambda raw, name: [{"text": name, "kind": "paragraph", "level": 0}] if name == "a.txt" else 1 / 0)
    assert {r.source: [b.text for b in r.blocks] for r in taken.collect()} == {"a.txt": ["a.txt"], "b.pdf": ["The Title", "First (line)\nsecond line", "an item"]}


def test_turns_and_refusals(spark):
    rows = spark.createDataFrame([(1, "q?", "[1] (s)\nbody", "Guntur", "User: a"), (2, "q?", None, None, None)], "n int, q string, c string, p string, h string")
    out = [r[0] for r in rows.orderBy("n").select(answer.user_turn(F.col("q"), F.col("c"), F.col("p"), F.col("h"), True)).collect()]
    assert "from Guntur district" in out[0] and "[1] (s)" in out[0] and out[0].index("EARLIER") < out[0].index("PLACE") < out[0].index("PASSAGES") < out[0].index("QUESTION")
    assert "(none)" in out[1] and "PLACE" not in out[1]
    assert [r[0] for r in spark.range(4).select(answer.fallback(F.col("id"))).collect()] == [*answer.FALLBACKS, answer.FALLBACKS[0]]
