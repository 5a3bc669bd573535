"""What a text is about, by counts of fixed signals: category, topics, party, and names of schemes and people."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: signals of categories, topics and parties, in the order that breaks ties
CATEGORIES: dict[str, list[str]] = {
    "manifesto": ["manifesto", "our promises", "we pledge", "vision document", "poll promise", "election manifesto", "commitments to the people", "declaration"],
    "district_info": ["district profile", "demographics", "constituency", "mandal", "population", "literacy rate", "assembly segment", "voter turnout", "electorate", "polling station"],
    "candidate_profile": ["candidate profile", "biography", "born in", "educational qualification", "political career", "assets declaration", "affidavit", "mla", "mp", "contesting from", "profile of"],
    "scheme": ["scheme", "yojana", "beneficiary", "eligibility criteria", "subsidy", "pension", "welfare programme", "welfare program", "financial assistance", "per annum", "disbursed", "rythu", "amma vodi", "direct benefit transfer"],
    "faq": ["frequently asked", "faq", "q:", "q.", "question:", "answer:", "how do i", "what is the process", "who is eligible"],
    "press_release": ["press release", "for immediate release", "media statement", "press note"],
    "speech": ["my dear brothers and sisters", "speech", "address to the", "namaskaram", "transcript of"],
}
TOPICS: dict[str, list[str]] = {
    "agriculture": ["farmer", "rythu", "crop", "irrigation", "agriculture", "paddy", "msp", "minimum support price", "fertiliser", "fertilizer", "kisan"],
    "education": ["school", "college", "student", "scholarship", "education", "university", "amma vodi", "vidya", "teacher", "literacy"],
    "healthcare": ["hospital", "health", "aarogyasri", "medical", "doctor", "clinic", "insurance", "phc", "arogya"],
    "employment": ["job", "employment", "unemployment", "skill development", "youth", "recruitment", "vacancy", "livelihood"],
    "women_welfare": ["women", "mahila", "self help group", "shg", "girl child", "maternity", "widow", "dwcra"],
    "infrastructure": ["road", "bridge", "metro", "highway", "port", "airport", "flyover", "connectivity", "electrification"],
    "water": ["water", "drinking water", "canal", "reservoir", "polavaram", "godavari", "krishna river", "borewell", "tap"],
    "housing": ["house", "housing", "pucca", "shelter", "layout", "navaratnalu house", "ptm"],
    "pension_welfare": ["pension", "old age", "disability", "welfare", "ration", "bpl", "white card"],
    "industry": ["industry", "msme", "investment", "factory", "industrial corridor", "startup", "sez"],
    "energy": ["power", "electricity", "solar", "renewable", "free units", "discom"],
    "law_order": ["police", "crime", "law and order", "safety", "disha", "security"],
    "fisheries": ["fisher", "aqua", "fishing", "harbour", "harbor", "prawn"],
    "transport": ["bus", "rtc", "transport", "railway", "train", "auto"],
}
PARTIES: dict[str, list[str]] = {
    "YSRCP": ["ysrcp", "ysr congress", "yuvajana sramika rythu congress"],
    "TDP": ["tdp", "telugu desam", "telugu desam party"],
    "JSP": ["jana sena", "janasena", "jsp"],
    "BJP": ["bharatiya janata party", "bjp"],
    "INC": ["indian national congress", "congress party"],
    "BRS": ["brs", "bharat rashtra samithi", "trs", "telangana rashtra samithi"],
}
SAMPLE_CHARS, MOST_PER_SIGNAL, IN_FILE_NAME, NAMED_BY_FILE, LEAST_QUESTIONS, PER_QUESTION, LONG_SIGNAL = 8000, 5, 8, 12, 3, 3, 6
QUESTION_LINE = r"(?im)^\s*(?:Q\d*[.:)]|Question\s*\d*[.:])"
SCHEME = (
    r"\b((?:[A-Z][\p{L}\p{N}_'’-]+\s+){0,3}"
    r"(?:Yojana|Yojna|Scheme|Bharosa|Vodi|Deevena|Sethu|Kanuka|Nestham|Aasara|Pension|Mission|Abhiyan|Card))\b"
)
PERSON = r"\b(?:Sri|Shri|Smt|Dr|Mr|Ms|Mrs|Hon(?:'|’)?ble)\.?\s+([A-Z][\p{L}\p{N}_'’.-]+(?:\s+[A-Z][\p{L}\p{N}_'’.-]+){0,3})"


def occurrences(low: Column, table: dict[str, list[str]]) -> dict[str, list[Column]]:
    """How often each signal stands in a lower-case text, without overlaps; the texts are searched in Arrow batches, all signals at once."""
    every = [s for signals in table.values() for s in signals]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[t.count(s) for s in every] for t in texts.to_pylist()], pa.list_(pa.int64()))

    counts, at = F.arrow_udf(run, "array<bigint>")(low), iter(range(len(every)))
    return {own: [F.get(counts, F.lit(next(at))) for _ in signals] for own, signals in table.items()}


def _ranked(scores: dict[str, Column], order: dict[str, Column] | None = None) -> Column:
    """Names with a score above 0, the highest first, ties in the order given (or that of ``order``)."""
    place = lambda i, name: (order or {}).get(name, F.lit(i))
    every = F.array(*[F.struct((-score).alias("score"), place(i, name).alias("i"), F.lit(name).alias("name")) for i, (name, score) in enumerate(scores.items())])
    return F.transform(F.array_sort(F.filter(every, lambda s: s["score"] < 0)), lambda s: s["name"])


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def lowered(text: Column) -> Column:
    """The text as signals are counted in; a column of its own where several functions share it, so that it is made once."""
    return F.lower(F.coalesce(text, F.lit("")))


def category(text: Column, file_name: Column, low: Column | None = None) -> Column:
    """The category with the highest score over the first characters (``low``: those lowered) and the file name; ``other`` without any signal."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE_CHARS)
    low, name = lowered(sample) if low is None else low, F.lower(F.coalesce(file_name, F.lit("")))
    bare = F.regexp_replace(name, "[_-]", "")
    questions = F.regexp_count(sample, F.lit(QUESTION_LINE)).cast("long")
    scores, order = {}, {}
    for own, counts in occurrences(low, CATEGORIES).items():
        parts = [F.least(F.lit(MOST_PER_SIGNAL), n) + F.when(F.contains(name, F.lit(s)), IN_FILE_NAME).otherwise(0) for s, n in zip(CATEGORIES[own], counts, strict=True)]
        parts.append(F.when(F.contains(bare, F.lit(own.replace("_", ""))), NAMED_BY_FILE).otherwise(0))
        if own == "faq":  # known by its questions alone it comes last among equals
            order[own] = F.when(_total(parts) > 0, list(CATEGORIES).index(own)).otherwise(len(CATEGORIES))
            parts.append(F.when(questions >= LEAST_QUESTIONS, questions * PER_QUESTION).otherwise(0))
        scores[own] = _total(parts)
    return F.coalesce(F.try_element_at(_ranked(scores, order), F.lit(1)), F.lit("other"))


def _by_signals(low: Column, table: dict[str, list[str]]) -> Column:
    return _ranked({own: _total(counts) for own, counts in occurrences(low, table).items()})


def topics(text: Column, limit: int = 4, low: Column | None = None) -> Column:
    """Up to ``limit`` topics by how often their signals occur."""
    low = lowered(text) if low is None else low
    return F.slice(_by_signals(low, TOPICS), 1, limit)


def party(text: Column, low: Column | None = None) -> Column:
    low = lowered(text) if low is None else low
    return F.try_element_at(_by_signals(low, PARTIES), F.lit(1))


def _names(text: Column, pattern: str) -> Column:
    capital = r"\b(?=[A-Z])" + pattern.removeprefix(r"\b")  # with which all of them begin: most places are passed by at once
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(capital), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))))


def schemes(text: Column, limit: int = 8) -> Column:
    """Names of schemes of two words or more, in order."""
    return F.slice(F.filter(_names(text, SCHEME), lambda n: F.contains(n, F.lit(" "))), 1, limit)


def people(text: Column, limit: int = 6) -> Column:
    """Names after an honorific, in order."""
    return F.slice(_names(text, PERSON), 1, limit)


def category_hint(text: Column) -> Column:
    """The first category with one of its longer signals in a question."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for own, signals in reversed(CATEGORIES.items()):
        some = [F.contains(low, F.lit(s)) for s in signals if len(s) > LONG_SIGNAL]
        if some:
            any_of = some[0]
            for more in some[1:]:
                any_of = any_of | more
            out = F.when(any_of, own).otherwise(out)
    return out


def topic_hint(text: Column) -> Column:
    """The topic with the most different signals in a question."""
    low = F.lower(text)
    return F.try_element_at(_ranked({own: _total([F.contains(low, F.lit(s)).cast("int") for s in signals]) for own, signals in TOPICS.items()}), F.lit(1))
