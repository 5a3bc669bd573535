"""Text functions as Column expressions: they stay inside whole-stage code generation where Catalyst allows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orevein.functions import constants as K


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it (also inside the functions of arrays)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def longest_of(words: Iterable[str]) -> str:
    """A pattern of the longest of ``words`` at a place (a shorter one where what follows the pattern fails), as a trie: few signs are tried at each."""
    trie: dict = {}
    for word in words:
        node = trie
        for sign in word:
            node = node.setdefault(sign, {})
        node[""] = {}

    def part(node: dict) -> str:
        signs = sorted(sign for sign in node if sign)
        below = [re.escape(sign) + part(node[sign]) for sign in signs]
        if not below:
            return ""
        if len(below) > 8:  # a look at the first sign rules out several at once
            below = [f"(?=[{re.escape(''.join(signs[i : i + 5]))}])(?:{'|'.join(below[i : i + 5])})" for i in range(0, len(below), 5)]
        one = below[0] if len(below) == 1 and "" not in node else f"(?:{'|'.join(below)})"
        return one + ("?" if "" in node else "")

    return part(trie)


def stem(token: Column) -> Column:
    """Strip the first suffix that fits, in order; at least three letters stay."""
    out = token
    for suffix in reversed(K.TERM_SUFFIXES):
        n = len(suffix)
        out = F.when(token.endswith(suffix) & (F.length(token) - n >= 3), token.substr(F.lit(1), F.length(token) - n)).otherwise(out)
    return F.when((F.length(token) > 4) & F.right(token, F.lit(1)).isin("s", "g", "d"), out).otherwise(token)


def terms(text: Column) -> Column:
    """BM25 terms: lower case, stop words dropped before stemming."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(K.TERM_PATTERN), F.lit(0))
    return F.transform(F.filter(found, lambda t: ~t.isin(*K.TERM_STOP_WORDS)), stem)


def answer_tokens(text: Column) -> Column:
    """The set of longer words without stop words that extractive answers compare."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*K.ANSWER_STOP_WORDS)))


def clean(text: Column) -> Column:
    """Typographic signs replaced, hyphens at line ends joined, blanks and blank lines collapsed."""
    out = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), K.REPLACEMENTS, F.coalesce(text, F.lit("")))
    for pattern, to in ((r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def script_language(text: Column) -> Column:
    """Language hint from the script of the first 4000 characters."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    return F.when(sample.rlike(r"[\x{0C00}-\x{0C7F}]"), "te").when(sample.rlike(r"[\x{0900}-\x{097F}]"), "hi").when(sample.rlike(r"[\x{0B80}-\x{0BFF}]"), "ta").otherwise("en")


def char_windows(text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Fixed-size windows in steps of ``size - overlap``; no window for an empty text."""
    step = max(1, size - overlap)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substr(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column, min_chars: int = 40) -> Column:
    """Sentences; one that follows a piece of fewer than ``min_chars`` characters joins it."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?\x{0964}])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    empty = F.array().cast("array<string>")

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when((F.size(out) > 0) & (F.length(F.try_element_at(out, F.lit(-1))) < min_chars), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(parts, empty, add)


def snippet(text: Column, limit: int = 220) -> Column:
    """One line of at most ``limit`` characters, cut at the last space, with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…")))


def dedupe_prefix(text: Column) -> Column:
    return F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), 1, K.DEDUPE_PREFIX)


def tidy(text: Column) -> Column:
    flat = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"\s+([.,;:])", "$1")
    return let(flat, lambda x: F.when((x == "") | x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))


# --- fixed values: what a speech engine shouldn't read, in the order replaced
SPEECH_RULES = (
    (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+", ""),
    (r"\[\d{1,2}\]", ""),
    (r"\*\*\*(.+?)\*\*\*", "$1"),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"__(.+?)__", "$1"),
    (r"(?s)`{1,3}(.+?)`{1,3}", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\[(.+?)\]\((?:.+?)\)", "$1"),
    (r"(?m)^\s*[-*+•]\s+", ""),
    (r"(?m)^\s*\d+[.)]\s+", ""),
    (r"\|", ", "),
    (r"[#>]", ""),
    (r"\bRs\.?\s*", "rupees "),
    (r"\n\s*\n", ". "),
    (r"\s+", " "),
    (r"\s+([.,!?])", "$1"),
    (r"\.{2,}", "."),
    (r"^\s+|\s+$", ""),
)


def speech_text(text: Column) -> Column:
    """What a speech engine should read: no emoji, citation markers or Markdown; currency spelled out."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in SPEECH_RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def citation_numbers(text: Column, upper: Column) -> Column:
    """Distinct ``[n]`` markers from 1 to ``upper``, in the order of first use."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= upper)))


def name_tokens(name: Column) -> Column:
    """The set of a name's words: lower case, no punctuation, possessives or honorifics."""
    outer, inner = r"^[.,;:!?()\"'’-]+|[.,;:!?()\"'’-]+$", r"^[.,'’-]+|[.,'’-]+$"
    words = F.transform(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, outer, ""), r"['’]s$", ""), r"(?<=s)['’]$", ""), inner, ""))
    titles = strings(K.HONORIFICS)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(titles, w)))


def name_f1(a: Column, b: Column) -> Column:
    """F1 of the two token sets, four digits; 0 if either is empty."""
    x, y = name_tokens(a), name_tokens(b)
    common = F.size(F.array_intersect(x, y))
    return F.when(common > 0, F.round(F.lit(2.0) * common / (F.size(x) + F.size(y)), 4)).otherwise(F.lit(0.0))


def content_id(source: Column, raw: Column) -> Column:
    """Identifier of a document's content: the same bytes give the same one."""
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat(source, F.lit(":"), F.substring(raw, 1, 20000))), 1, 16))


def context_header(place: Column, category: Column, path: Column, source: Column) -> Column:
    """Place, category, the last two headings and the file stem, distinct and in order."""
    crumbs = F.array_join(F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), 2), " › ")
    stem_ = F.regexp_replace(source, r"\.[^.]+$", "")
    parts = F.filter(F.array(place, category, crumbs, stem_), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(parts), " | ")
