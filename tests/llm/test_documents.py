"""Operators on documents against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orevein.llm import exact_dedup, near_dedup, paragraph_dedup, source_mix, suffix_dedup
from tests.llm.fixtures import docs_frame, documents, prose


def normalised(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


def test_exact_dedup(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[normalised(r[1])].append(r[0])
    expected = Counter((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    out = exact_dedup.exact_dedup(docs_frame(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == expected
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_rows_whole(spark):
    docs = docs_frame(spark)
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns and out.count() == len({normalised(r[1]) for r in documents()})


def test_exact_dedup_of_a_group_that_fills_partitions(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'same  text' text").repartition(4)
    out = exact_dedup.exact_dedup(docs).collect()
    assert {(r.keep_id, r.group_size) for r in out} == {(0, 4000)} and [r.doc_id for r in out if r.kept] == [0]


def shingles(t, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^ \t-\r]+", low)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(sets, threshold=0.8):
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def test_near_dedup(spark):
    rows = documents()
    label = classes([shingles(r[1]) for r in rows])
    members = defaultdict(list)
    for r, k in zip(rows, label, strict=True):
        members[k].append(r[0])
    expected = Counter((r[0], min((x for x in members[k] if x is not None), default=None), len(members[k])) for r, k in zip(rows, label, strict=True))
    out = near_dedup.near_classes(docs_frame(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == expected
    assert sum(r.kept for r in out) == len(members)
    kept = near_dedup.keep_first(docs_frame(spark))
    assert kept.columns == docs_frame(spark).columns and kept.count() == len(members)


def test_prob_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(60))
    m = 4096
    both = near_dedup.prob_minhash(np.repeat([0, 1], 60), np.tile(h, 2), np.concatenate([a, b]), 2, m)
    assert abs((both[0] == both[1]).mean() - exact) < 0.04


def test_paragraph_dedup(spark):
    out = {r.doc_id: r for r in paragraph_dedup.repeated_paragraphs(docs_frame(spark)).collect() if r.doc_id not in (1, 11)}
    assert out[10].n_removed >= 1 and out[9].n_removed == 0 and out[9].n_repeated == out[10].n_removed
    assert out[13].n_removed == out[13].n_repeated > 0 and out[2].n_paragraphs == out[3].n_paragraphs == 0
    assert out[16].n_removed == 0 and out[14].n_removed == 0
    docs = docs_frame(spark).filter("doc_id = 10").select("doc_id", "text")
    stripped = paragraph_dedup.without_paragraphs(docs.join(spark.createDataFrame([(10, list(out[10].removed))], "doc_id long, removed array<int>"), "doc_id")).first()
    original = next(r[1] for r in documents() if r[0] == 10)
    assert len(stripped.text.split()) == len(original.split()) - out[10].removed_words


def test_near_dedup_finds_copies_that_repeat_a_line(spark):
    rows = []
    for i in range(20):
        text = [f"w{i}x{k}" for k in range(200)]
        line = " ".join(text[90:100])
        rows += [(i, " ".join(text)), (100 + i, " ".join(text[:100]) + "\n" + f"{line}\n" * 50 + " ".join(text[100:]))]
    sets = [shingles(t) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    out = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(i + d, i, 2) for i in range(20) for d in (0, 100)}


def planted(kind):
    """Pairs of texts that share a passage of 60 words without sentence ends: wrapped, mid-line, or wrapped in one and mid-line in the other."""
    rows, passages = [], {}
    for i in range(40):
        passage = prose(1000 + i, 60).replace(".", "").split()
        for j in range(2):
            every = prose(2000 + 2 * i + j, 80 + i % 8).replace(".", "").split() + passage + prose(3000 + 2 * i + j, 80).replace(".", "").split()
            wrap = kind == "wrapped" or (kind == "mixed" and j)
            rows.append((100 * j + i, "\n".join(" ".join(every[k : k + 8]) for k in range(0, len(every), 8)) if wrap else " ".join(every)))
        passages[i] = passage
    return rows, passages


@pytest.mark.parametrize("kind", ["wrapped", "mid-line", "mixed"])
def test_paragraph_dedup_finds_passages_without_line_or_sentence_ends(spark, kind):
    rows, passages = planted(kind)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in paragraph_dedup.repeated_paragraphs(docs).collect()}
    assert all(out[i].n_removed == 0 and out[i].n_words == len(rows[2 * i][1].split()) for i in passages)
    left = paragraph_dedup.without_paragraphs(docs.join(spark.createDataFrame([(r.doc_id, r.removed) for r in out.values()], "doc_id long, removed array<int>"), "doc_id")).collect()
    texts = dict(rows)
    for r in left:
        assert len(r.text.split()) == len(texts[r.doc_id].split()) - out[r.doc_id].removed_words
    found = [out[100 + i].removed_words / len(p) for i, p in passages.items()]
    assert max(found) <= 1 and min(found) > 0 and sum(found) / len(found) > 0.7
    assert [r for r in out.values() if r.n_repeated and r.doc_id < 100]


def removed(rows):
    """Brute force over all starts, in the order of documents."""
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        out.append((len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [500, 1])
def test_suffix_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = sorted(((r[0], r[1]) for r in documents()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    expected = Counter((r[0], *x) for r, x in zip(rows, removed(rows), strict=True))
    out = suffix_dedup.substring_dedup(docs_frame(spark)).collect()
    assert Counter(map(tuple, out)) == expected


def test_column_wise_is_the_transform(tmp_path):
    strings = [b"abracadabra", b"cadabra", b"", b"aaaa", b"abra"]
    raw, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    bwt, lcp = suffix_dedup.column_wise(raw, ends, str(tmp_path))
    suffixes = sorted((list(s[k:]) + [-1, i], s[k - 1] + 1 if k else 0) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert bwt.tolist() == [c for _, c in suffixes]

    def common(a, b):
        n = 0
        while a[n] == b[n] and a[n] >= 0:
            n += 1
        return n

    assert lcp.tolist() == [0, *[common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]]


def test_source_mix(spark):
    out = source_mix.mix_sources(docs_frame(spark)).collect()
    rows = documents()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^ \t-\r]+", r[1] or ""))
    by_source = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(by_source, [3, 1, 2, 3], strict=True))
    target, left = {}, set(by_source)
    budget = 1.5 * sum(sizes.values())
    while True:  # share again and again, as the contract says
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
            left.discard(s)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in by_source)
    assert sorted(map(str, out)) == sorted(map(str, source_mix.mix_sources(docs_frame(spark).repartition(5)).collect()))


def test_repeated_rows_of_the_mixture(spark):
    docs = docs_frame(spark)
    out = source_mix.repeat_rows(docs)
    assert out.columns == docs.columns
    assert max(Counter(r.doc_id for r in out.filter("doc_id not in (1, 11)").collect()).values()) <= 2


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, near_dedup.near_classes, paragraph_dedup.repeated_paragraphs, suffix_dedup.substring_dedup, source_mix.mix_sources])
def test_empty_table(spark, operator):
    assert operator(docs_frame(spark, [])).count() == 0
