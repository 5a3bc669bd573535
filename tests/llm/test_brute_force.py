"""Operators that SQL cannot express against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from orevein.llm import bpe, lattice, near_dedup, nearlink, paragraph_dedup, quality, suffix_dedup, words
from orevein.llm import langid as language
from tests.llm.fixtures import DOCS, docs_frame, documents, prose
from tests.llm.test_documents import classes, normalised, removed, shingles


def edited(text: str, seed: int, share: float) -> str:
    """``text`` with about ``share`` of its words replaced, in one run (which costs few shingles)."""
    w = text.split(" ")
    n = round(len(w) * share)
    at = random.Random(seed).randrange(len(w) - n)
    return " ".join([*w[:at], *prose(seed, n).split(" "), *w[at + n :]])


def families(seed: int, sizes: list[int], share: float) -> list[tuple[int, str]]:
    """Families of variants of one text each; the more edited ones lie on either side of the threshold."""
    rows = []
    for f, size in enumerate(sizes):
        base = prose(seed + f, 120)
        rows += [base if k == 0 else edited(base, seed * 1000 + f * 100 + k, share * (k % 7) / 6) for k in range(size)]
    return list(enumerate(rows))


def near_rows(rows: list[tuple]) -> Counter:
    label = classes([shingles(t) for _, t in rows])
    members = defaultdict(list)
    for (i, _), k in zip(rows, label, strict=True):
        members[k].append(i)
    return Counter((i, min(members[k]), len(members[k])) for (i, _), k in zip(rows, label, strict=True))


@pytest.mark.parametrize("block", [512, 6])
def test_near_dedup_of_large_families(spark, monkeypatch, block):
    monkeypatch.setattr(nearlink, "BLOCK", block)
    rows = families(50, [60, 25, 9, 3, 1], 0.16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = near_dedup.near_classes(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == near_rows(rows)


def test_a_line_repeated_many_times_costs_no_recall(spark):
    """The pair of set similarity 0.96 whose counts differ by a run repeated 200 times."""
    rows = []
    for i in range(25):
        text = [f"v{i}y{k}" for k in range(200)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:60], *(text[60:72] * 200), *text[72:]]))]
    out = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = near_rows(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == expected and all(n == 2 for _, _, n in expected)


def test_keep_first_goes_by_row(spark):
    base = prose(77, 150)
    rows = [(1, base), (1, prose(78, 90)), (2, edited(base, 5, 0.02)), (2, edited(base, 5, 0.02)), (None, edited(base, 6, 0.02)), (None, prose(79, 60)), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, __n string, __digest string, kept int").repartition(3)
    out = near_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([rows[0], rows[1], rows[5], rows[6], rows[7], rows[8]])


def test_sweep_keeps_buckets_of_several_items():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(30)
        rows = sorted((rng.randrange(8), rng.randrange(4)) for _ in range(n))
        cuts = sorted(rng.randrange(n + 1) for _ in range(rng.randrange(4)))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], names=["bucket", "item"]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        out = [tuple(x.values()) for o in nearlink._several(iter(batches)) for x in o.to_pylist()]
        distinct = sorted(set(rows))
        items = Counter(b for b, _ in distinct)
        edges = {distinct[0][0], distinct[-1][0]} if distinct else set()
        assert sorted(out) == [r for r in distinct if items[r[0]] > 1 or r[0] in edges]


def test_recent_items_never_hide_a_new_one():
    recent, seen = words.Recent(4), set()
    rng = np.random.default_rng(3)
    for _ in range(200):
        items = np.unique(rng.integers(1, 60, 10)).astype(np.uint64)
        fresh = recent.fresh(items)
        assert set(items.tolist()) - set(items[fresh].tolist()) <= seen
        seen |= set(items.tolist())


def paragraph_parts(texts: list[str | None]) -> tuple[list[list[tuple]], list[list[int]]]:
    """Of each text its parts ``(first piece, pieces, words, whether a paragraph)`` and the sizes of its pieces."""
    parts, sizes = [], []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        every = tuple(w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in own).split(" ") if w)
        _, _, firsts, of, whole = paragraph_dedup.pieces(raw, np.array([0, len(raw)]))
        n, begins = len(of), [k for k in range(len(of)) if whole[k]]
        found = [(a, b - a, every[firsts[a] : firsts[b]], True) for a, b in zip(begins, [*begins[1:], n] if n else [], strict=True)]
        pairs = {a for a, k, _, _ in found if k == 2}
        found = [p for p in found if len(p[2]) >= paragraph_dedup.MIN_WORDS]
        parts.append(found + [(k, 2, every[firsts[k] : firsts[k + 2]], False) for k in range(n - 1) if k not in pairs])
        sizes.append(np.diff(firsts).tolist() if n else [])
    return parts, sizes


def test_paragraph_dedup_is_the_pairwise_comparison(spark):
    shared = [prose(600 + k, 40) for k in range(6)]
    texts = []
    for i in range(30):
        rng = random.Random(i)
        blocks = [prose(700 + i, 30), edited(shared[i % 6], i, rng.choice([0, 0, 0.05, 0.1, 0.3])), prose(800 + i, 25), shared[(i + 1) % 6]]
        texts.append(rng.choice(["\n", ".\n\n", " "]).join(blocks))
    texts += [None, "", "one two", texts[3], "a b c d e f g h i j " * 5]
    parts, sizes = paragraph_parts(texts)
    contents = list(dict.fromkeys(p[2] for own in parts for p in own))
    compared = {p[2] for own in parts for p in own if p[3]}
    grams = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w in compared else set() for w in contents]
    label = dict(zip(contents, classes(grams), strict=True))
    seen = sorted((i, a, n, label[w]) for i, own in enumerate(parts) for a, n, w, _ in own)
    count, first = Counter(x[3] for x in seen), {}
    for i, a, n, k in seen:
        first.setdefault(k, (i, a + n))
    gone, known = defaultdict(set), defaultdict(set)
    for i, a, n, k in seen:
        if count[k] > 1:
            known[i] |= set(range(a, a + n))
            if i != first[k][0] or a >= first[k][1]:
                gone[i] |= set(range(a, a + n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in paragraph_dedup.repeated_paragraphs(docs).collect()}
    assert len(out) == len(texts) and any(gone.values())
    for i, r in out.items():
        assert (list(r.removed), r.n_paragraphs, r.n_repeated) == (sorted(gone[i]), len(sizes[i]), len(known[i])), i
        assert (r.n_words, r.removed_words) == (sum(sizes[i]), sum(sizes[i][k] for k in gone[i]))


def test_ftrl_by_hand():
    rng = random.Random(4)
    examples = [(float(rng.random() < 0.5), sorted(rng.sample(range(40), 6)), [rng.random() for _ in range(6)]) for _ in range(50)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for label, index, value in examples:
            w = {i: weight(i) for i in index}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(index, value, strict=True))))
            for i, v in zip(index, value, strict=True):
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    fitted = quality.fit_ftrl([(y, np.array(i), np.array(v)) for y, i, v in examples])
    assert np.allclose(fitted[:40], [weight(i) for i in range(40)]) and not fitted[40:].any()


def quality_tokens(text: str) -> list[tuple[bytes, tuple]]:
    kind = lambda b: 0 if b in b" \t\n\v\f\r" else 2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 3
    out, held = [], b""
    for b in text.encode():
        if held and kind(b) != kind(held[-1]):
            out.append(held)
            held = b""
        held += bytes([b])
    out = [t for t in [*out, held] if t and kind(t[0])]
    shaped, before = [], None
    for t in out:
        upper = sum(65 <= b <= 90 for b in t)
        case = 0 if not upper else 1 if upper == len(t) else 2 if upper == 1 and 65 <= t[0] <= 90 else 3
        shaped.append((t, "repeat" if t == before else (kind(t[0]), case, min(len(t), 15))))
        before = t
    return shaped


def test_quality_scores_are_sparse_dot_products(spark):
    texts = [r[1] for r in documents()] + ["Ab AB ab aB 12 12 -- 3.5", "é"]
    column = pa.array(texts, pa.string())
    raw, ends = words.buffers(column)
    numbers, offsets = quality.features(raw, ends)
    meaning = {}  # a feature number stands for one n-gram (but for rare collisions of hashes)
    clashes = 0
    for k, text in enumerate(texts):
        tokens = quality_tokens(text or "")
        grams = [("s", t) for t, _ in tokens] + [("k", s) for _, s in tokens]
        grams += [("s", a[0], b[0]) for a, b in zip(tokens, tokens[1:], strict=False)] + [("k", a[1], b[1]) for a, b in zip(tokens, tokens[1:], strict=False)]
        own = numbers[offsets[k] : offsets[k + 1]].tolist()
        assert len(own) == len(grams)
        for i, g in zip(own, grams, strict=True):
            clashes += meaning.setdefault(g, i) != i
    assert not clashes and len(set(meaning.values())) > 0.98 * len(meaning)
    w = np.random.default_rng(2).standard_normal(quality.BUCKETS + 1)
    out = [r.score for r in quality.with_score(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), w).collect()]
    for k, score in enumerate(out):
        own = numbers[offsets[k] : offsets[k + 1]]
        margin = w[quality.BUCKETS] + (quality.SCALE * w[own].sum() / len(own) if len(own) else 0)
        assert score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, margin)))), abs=1e-9)
    alone = quality.with_score(spark.createDataFrame([(t,) for t in reversed(texts)], "text string").repartition(7), w).collect()
    assert sorted(r.score for r in alone) == sorted(out)  # not a bit depends on what stands beside a text


def language_grams(text: str) -> list[int]:
    points = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = []
    for n in language.ORDERS:
        for k in range(len(points) - n + 1):
            gram = points[k : k + n]
            if gram.strip(" "):
                out.append(int(language._grams(np.array([ord(c) for c in gram], np.uint32), n)[0][0]))
    return out


def test_language_scores_by_hand(spark):
    rows = [(i, t, ["xx", "yy", None][i % 3]) for i, t in enumerate([r[1] for r in documents()] + ["Üb är", "ab", "zq"])]
    counts, docs = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if text is not None and lang and language_fold(i) != 2:
            counts[lang].update(language_grams(text))
            docs[lang] += 1
    langs = sorted(docs)
    out = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(out) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in out:
        text = texts[r.doc_id]
        assert r.held_out == (language_fold(r.doc_id) == 2)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = {}
        for lang in langs:
            every = sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS
            prior = math.log((docs[lang] + 1) / (sum(docs.values()) + len(langs)))
            total[lang] = prior + sum(math.log((counts[lang][g] + language.SMOOTHING) / every) for g in language_grams(text))
        best = max(langs, key=lambda x: total[x])
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(total[x] - total[best]) for x in langs), rel=1e-3)


def language_fold(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4


def test_suffix_dedup_over_many_collections(spark, monkeypatch):
    """Collections of a few hundred bytes, with and without repeats; common passages at the edges of many texts; a text of over a megabyte."""
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 400)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    passage, other = prose(1, 50), prose(2, 30)
    rows = [(i, prose(100 + i, 20) + passage[(i % 9) :] + prose(200 + i, 20 + i % 3)) for i in range(60)]
    rows += [(100 + i, prose(300 + i, 60)) for i in range(10)] + [(200, other * 3), (201, prose(9, 9000) + passage + other), (202, "x" * 700), (203, "xy" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = Counter((r[0], *x) for r, x in zip(rows, removed(rows), strict=True))
    assert Counter(map(tuple, suffix_dedup.substring_dedup(docs).collect())) == expected
    unlike = spark.createDataFrame([(i, prose(400 + i, 80)) for i in range(8)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in suffix_dedup.substring_dedup(unlike).collect())


def test_suffix_dedup_of_a_text_over_a_megabyte(spark):
    big = prose(31, 260_000)
    assert len(big) > 2 * suffix_dedup.CHUNK
    cut = big[700_000:700_400]
    rows = [(1, big), (2, prose(5, 30) + cut + prose(6, 30)), (3, cut)]
    out = {r.doc_id: r for r in suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[3].n_removed, out[3].kept_sha256) == (400, hashlib.sha256(b"").hexdigest())
    raw = rows[1][1].encode()
    low = raw.index(cut.encode())
    assert out[2].n_spans == 1 and 400 <= out[2].n_removed <= 404 and out[1].n_removed == sum(out[1].n_removed for _ in range(1))
    assert out[2].n_bytes == len(raw) and low > 0


def test_collection_without_repeats_gives_no_intervals():
    raw, ends = words.buffers(pa.array([b"a" * 50 + bytes(range(60, 120)), bytes(range(130, 250))], pa.binary()))
    text, start = suffix_dedup.repeated_starts(raw, ends, np.array([1, 2]), np.array([0, 0]))
    assert suffix_dedup._intervals(text, start).num_rows == 0


def test_pieces_are_compared_with_their_minimiser_as_one_symbol(monkeypatch):
    """The transform takes 105 rounds at most, for whole pieces 152, and finds the repeats that plain Python finds among the pieces."""
    lengths, inner = [], suffix_dedup.column_wise
    monkeypatch.setattr(suffix_dedup, "column_wise", lambda raw, ends, folder: lengths.extend(np.diff(ends)) or inner(raw, ends, folder))
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 5000)
    monkeypatch.setattr(suffix_dedup, "ROWS", 7, raising=False)
    base = prose(50, 200)
    texts = [edited(base, 60 + i, 0.1) for i in range(12)] + ["é😀" * 90, "xy" * 120, "x" * 150, "é😀" * 40 + "xy" * 80, base.upper(), base]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["num", "text"])
    found = pa.Table.from_batches(suffix_dedup._occurrences(iter([docs]))).to_pylist()
    rows = [(r["key"], r["num"], r["at"], texts[r["num"]].encode()[r["at"] : r["at"] + r["count"] + 99]) for r in sorted(found, key=lambda r: (r["key"], r["num"]))]
    assert max(len(r[3]) for r in rows) > 130
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "num", "at", "bytes"])
    out = [x for b in suffix_dedup._compare(iter([batch])) for x in b.to_pylist()]
    strings = defaultdict(list)
    for _, num, at, data in rows:
        for k in range(len(data) - 99):
            strings[data[k : k + 100]].append((num, at + k))
    assert sorted((x["num"], k) for x in out for k in range(x["low"], x["high"])) == sorted(place for places in strings.values() for place in sorted(places)[1:])
    assert max(lengths) <= 105


def test_equal_surroundings_of_different_minimisers_are_not_equal():
    left, right, grams = b"l" * 52, b"r" * 52, [b"a" * 48, b"b" * 48, b"a" * 48]
    mark = bytes([suffix_dedup.MARK])
    raw, ends = words.buffers(pa.array([left + mark + right] * 3, pa.binary()))
    kind = pa.array(grams).dictionary_encode().indices.to_numpy()
    text, start = suffix_dedup.repeated_starts(raw, ends, np.array([1, 2, 3]), np.zeros(3, np.int64), suffix_dedup.FOLDED, kind)
    assert sorted(zip(text.tolist(), start.tolist(), strict=True)) == [(3, k) for k in range(53)]


def test_embedding_links_of_doubles_and_text_labels(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 24))
    rows = [(i, (base[i % 6] + rng.standard_normal(24) * 0.05).tolist(), "ab"[i % 2]) for i in range(60)] + [(90, base[0].tolist(), None)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & np.array([[a[2] == b[2] and a[2] is not None and a[0] != b[0] for b in rows] for a in rows])
    out = {r.vec_id: r for r in lattice.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3), block=8).collect()}
    assert [out[r[0]].n_links for r in rows] == link.sum(axis=1).tolist() and link.any()


def test_projections_do_not_depend_on_the_batch():
    x = lattice._unit(np.random.default_rng(1).standard_normal((300, 64)))
    space = np.zeros(300, np.uint64)
    whole = lattice.cells(x, space)
    assert all((lattice.cells(x[k : k + n], space[k : k + n]) == whole[k : k + n]).all() for k, n in ((0, 1), (7, 13), (100, 200)))


def mixed(rows: list[tuple]) -> Counter:
    """The mixture of ``(doc_id, text, source)`` in whole rows, as water-filling gives it."""
    size = [len([w for w in normalised(t).split(" ") if w]) for _, t, _ in rows]
    of = defaultdict(list)
    for k, r in enumerate(rows):
        of[r[2]].append(k)
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: [3.0, 1.0, 2.0][i % 3] for i, s in enumerate(order)}
    total = {s: sum(size[k] for k in of[s]) for s in order}
    target, left, budget = {}, set(order), 1.5 * sum(size)
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
            left.discard(s)
    out = Counter()
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        need = round(target[s]) - whole * total[s]
        key = lambda k: hashlib.md5(f"mix-1:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()
        for k in of[s]:
            out[rows[k]] += whole
        groups = defaultdict(list)
        for k in of[s]:
            groups[key(k)].append(k)
        for h in sorted(groups):
            words_here = sum(size[k] for k in groups[h])
            if need <= 0:
                break
            if words_here <= need or 2 * need >= words_here:
                out.update(rows[k] for k in groups[h])
            need -= words_here
    return +out


def test_pipeline_is_its_operators_by_hand(spark, tmp_path):
    """Every stage on awkward rows, each against plain Python over what the stage before it left."""
    tokenizers = pytest.importorskip("tokenizers")
    rows = documents() + [(300 + i, edited(prose(40 + i % 4, 90), i, 0.02 * (i % 3)), "en", ["s1", "s2", None][i % 3], 1, True, 5, 0.5, "h") for i in range(24)]
    labels = [(r[0], int(len(r[1] or "") > 60), 0) for r in rows if r[0] is not None]
    docs_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {(r.doc_id, r.text): r.score for r in quality.with_score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    left = [(r[0], r[1], r[3]) for r in rows if scores[(r[0], r[1])] >= quality.ACCEPT]
    order = lambda r: (r[0] is None, r[0] or 0)
    one = {}
    for r in sorted(left, key=order):
        one.setdefault(normalised(r[1]), r)
    left = sorted(one.values(), key=order)
    label, one = classes([shingles(r[1]) for r in left]), {}
    for k, r in zip(label, left, strict=True):
        one.setdefault(k, r)
    left = list(one.values())
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    expected = Counter()
    for (doc_id, text, _), n in mixed(left).items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += n
    out = corpus_pipeline.run(spark, sf).collect()
    assert expected and Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out) == expected


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
