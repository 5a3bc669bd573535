"""Checks of answers: figures, refusals, stated values in digits or words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: figures that need a source, phrases of refusals, names of numbers
FIGURE = r"(?i)(?:rs\.?|rupees)\s*[\d.]+\s*(?:lakh|crore)|\b\d{1,2}\s+[\p{L}\p{N}_]+\s+(?:19|20)\d{2}\b"
REFUSALS = (
    "don't have", "do not have", "no information", "not have any", "couldn't find", "could not find", "not in", "no record", "unable", "outside",
    "only answer", "no details", "isn't something", "is not something", "cannot", "can't help",
)
SMALL = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def spelled(n: int) -> str:
    """The words of a number from 0 to 99; digits beyond."""
    if n < 20:
        return SMALL[n]
    return f"{TENS[n // 10 - 2]}-{SMALL[n % 10]}".removesuffix("-zero") if n < 100 else str(n)


def states(answer: str | None, value: str | None) -> bool:
    """Whether an answer gives a value: as it stands, a number in words, a date in any order, or half of a text's longer words."""
    said, value = " ".join((answer or "").split()).lower(), (value or "").strip().lower()
    if value in said:
        return True
    if re.fullmatch(r"\d+(?:\.\d+)?", value):
        whole, _, part = value.partition(".")
        return spelled(int(whole)) in said and (not part or any(spelled(int(p)) in said for p in (part.ljust(2, "0"), part)))
    if date := re.match(r"(\d{1,2})\s+(\w+)\s+(\d{4})", value):
        return all(part in said for part in date.groups())
    words = re.findall("[a-z]{4,}", value)
    return bool(words) and sum(w in said for w in words) >= max(1, len(words) // 2)


def stated(answer: Column, value: Column) -> Column:
    def run(answers: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array([states(a, v) for a, v in zip(answers.to_pylist(), values.to_pylist(), strict=True)], pa.bool_())

    return F.arrow_udf(run, "boolean")(answer, value)


def holds_figure(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(FIGURE)


def declines(answer: Column) -> Column:
    low = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", " "))
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(low, p))


def names_any(answer: Column, names: Column) -> Column:
    """Whether an answer holds any of the names as whole words."""
    return F.coalesce(F.exists(names, lambda n: F.regexp_like(answer, F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b")))), F.lit(False))


def verdict(check: Column, answer: Column, cited: Column, forbidden: Column, expected: Column) -> Column:
    """The reason for which an answer fails its check (``conversational``, ``refusal``, ``no_fabrication`` or ``fact``), null if it passes.

    ``expected`` tells whether the values asked for are stated (see ``stated``).
    """
    short = F.length(F.trim(F.coalesce(answer, F.lit("")))) < 4
    leaked, figure = names_any(answer, forbidden), holds_figure(answer)
    talk = F.when(leaked, "names").when(figure, "figure").when(cited > 0, "cited").when(short, "empty")
    refused = F.when(leaked, "names").when(figure, "figure").when(~declines(answer), "not declined")
    unmade = F.when(figure & (cited == 0), "uncited figure").when(short, "empty")
    fact = F.when(~F.coalesce(expected, F.lit(False)), "missing value").when(leaked, "names").when(cited == 0, "uncited")
    return F.when(check == "conversational", talk).when(check == "refusal", refused).when(check == "no_fabrication", unmade).otherwise(fact)
