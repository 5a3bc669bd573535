"""Models, tokens, vectors, URLs and the pipeline."""

from __future__ import annotations

import hashlib
import json
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from orevein.llm import bpe, langid, lattice, quality, registry, url_rules
from orevein.session import load
from tests.conftest import rows_of, sql_rows
from tests.llm.fixtures import docs_frame, documents


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert rows_of(registry.queries()[name](spark, sf_dir)) == sql_rows(duck, registry.oracle_sql()[name])


def test_bpe_is_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    extra = ["ΣΑΣ İstanbul ß é x\u2003y\x1cz", "<|endoftext|>a <|startoftext|>B", "it's ''s 's'south we'll 日本語 12½ _a_ 🎉!!", "aaaaaaaaaaaa"]
    rows = documents() + [(100 + i, t, "en", "s", 1, True, 1, 0.1, "") for i, t in enumerate(extra)]
    out = bpe.encode_digests(docs_frame(spark, rows)).collect()
    expected = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter(map(tuple, out)) == expected
    tokens = bpe.decode(bpe.encode(docs_frame(spark, rows).select("doc_id", "text")))
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in tokens.collect())


def _bpe_words() -> list[str]:
    rng = random.Random(5)
    letters = ["ab", "en", "th", "er", "ing", "a", "é", "ß", "日", "ж", "🎉", "!", "-"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(3000)]


def test_bpe_of_words_of_any_length_is_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    edge = [c * n for c in "aeé日!🎉" for n in (1, 2, 3, 4, 5, 31, 32, 33, 63, 64, 65, 66, 1000)]
    rng = random.Random(6)
    long = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (64, 65, 500, 120_000)]
    texts = [*_bpe_words(), *edge, *long, " ".join(edge), "", None, "<|endoftext|>"]
    with open(bpe.default_path(), encoding="utf-8") as f:
        model = bpe.WordBpe(json.load(f))
    for text, words in zip(texts, model.encode(texts), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(b"".join([w[0] for w in words]), "<u4").tolist() == ids
        assert " ".join([w[1] for w in words]) == library.decode(ids, skip_special_tokens=False)


def test_bpe_takes_few_python_steps_for_a_new_word():
    with open(bpe.default_path(), encoding="utf-8") as f:
        model = bpe.WordBpe(json.load(f))
    new = sorted({w for text in _bpe_words() for w in model.split(text)})
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        if not frame.f_code.co_filename.endswith("bpe.py"):
            return None
        lines += event == "line"
        return count

    sys.settrace(count)
    try:
        model.learn(new)
    finally:
        sys.settrace(None)
    assert len(new) > 2000 and lines < 10 * len(new)


def test_bpe_cache_keeps_what_was_used_last(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    with open(bpe.default_path(), encoding="utf-8") as f:
        model = bpe.WordBpe(json.load(f))
    learnt, learn = Counter(), model.learn
    monkeypatch.setattr(model, "learn", lambda words: learn([learnt.update([w]) or w for w in words]))
    often = "the of and"
    for k in range(100):
        rare = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "qxzvw")
        words = model.encode([f"{often} {rare}"])[0]
        assert [w[1].replace("</w>", "").replace(" ", "") for w in words] == f"{often} {rare}".split(" ")
        assert len(model.cache) + len(getattr(model, "older", ())) <= 40
    assert all(learnt[w] == 1 for w in often.split(" "))


def test_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.language_id(docs).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r for r in langid.language_id(docs_frame(spark)).collect()}
    assert len(langid.language_id(docs_frame(spark)).collect()) == len(documents())
    assert {odd[i].lang_pred for i in (2, 3, 4, 15)} == {"und"} and odd[2].score == 0
    assert langid.language_id(docs_frame(spark, [])).count() == 0


def test_quality(spark, sf_dir):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents", "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.quality_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 0, None), (10, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs_frame(spark), labels).collect()
    assert len(out) == len(documents())
    none = quality.quality_scores(docs_frame(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs_frame(spark, []), labels).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)) * 2
    near = lattice.nearest_e8(x)
    around = near[:, None] + np.concatenate([np.zeros((1, 8)), lattice._neighbours()])[None]
    assert len(lattice._neighbours()) == 240
    assert (((x - near) ** 2).sum(1) <= ((x[:, None] - around) ** 2).sum(2).min(1) + 1e-9).all()


@pytest.mark.parametrize("block", [512, 4])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(90):
        v = base[i % 12] + rng.standard_normal(16) * 0.08 * (i % 5)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [], 0), (206, rows[0][1], None), (207, rows[0][1][:8], 0), (208, [None] * 16, 0), (3, rows[3][1], 1)]
    good = [len(r[1] or []) > 0 and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(np.float32(rows[k][1]), float) for k in (i, j))
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *[comp[j] for j in np.flatnonzero(link[i])]], key=lambda k: rows[k][0]) for i in range(n)]
    expected = Counter((rows[i][0], int(link[i].sum()), min(rows[j][0] for j in range(n) if comp[j] == comp[i])) for i in range(n))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = lattice.embedding_links(frame, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert lattice.embedding_links(frame.limit(0)).count() == 0


URLS = ["http://a.example.net/en/x?q#f", "https://EXAMPLE.net/EN/", "http://example.netx/en/", "x://net", "ftp://b.net/?a", None, "no scheme", "http://", "http://u@example.com/de/a", "http://example.com:80/de/", "http://x.example.com/de/://y", "//org/fr/", "http://org/fr/a", "http://forg/fr/a", "a b://é.org/fr/", "http://a.net/x\ny"]


def test_url_rules(spark):
    rules = [*url_rules.RULES, ("allow", "a.example.net", "/"), ("block", "a.example.net", "/en/x")]
    frame = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, verdict string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    expected = Counter((i, *judged(u)) for i, u in enumerate([*URLS, URLS[0]]))
    for block in (url_rules.BLOCK, 2):
        assert Counter(map(tuple, url_rules.url_verdicts(frame, rules, block=block).collect())) == expected
    assert url_rules.url_verdicts(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, rows, sf_dir)
        assert following.columns == docs.columns, name
        rows = following.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert last.count() == rows.count() == corpus_pipeline.run(spark, sf_dir).count()
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert max(Counter(ids).values()) <= 2
