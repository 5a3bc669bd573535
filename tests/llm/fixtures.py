"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, item long, score double, head string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "ke", "li", "mo", "su", "ra", "te"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def documents() -> list[tuple]:
    passage = prose(900, 60)
    near = prose(901, 200).split(" ")
    edited = [*near[:100], "changed", *near[101:]]
    texts = {
        1: prose(1, 120), 2: None, 3: "", 4: " \t\n ", 5: "one", 6: "One  two\tthree", 7: "one two three", 8: "One two three",
        9: prose(2, 80) + ".\n" + passage + ".\n" + prose(3, 50), 10: prose(4, 70) + ".\n" + passage + ".\n" + prose(5, 40),
        11: " ".join(near), 12: " ".join(edited), 13: " ".join(near), 14: "é ü ß " + prose(6, 30), 15: "12 34 !!", 16: prose(7, 4000), 17: "ab" * 300, 18: prose(8, 5),
    }
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s10"][i % 4], len(t or ""), True, 5, 0.5, "h") for i, t in texts.items()]
    return [*rows, rows[0], rows[10], (None, texts[7], "en", "s1", 1, False, 5, 0.5, "h")]


def docs_frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)
