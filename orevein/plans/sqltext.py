"""Fragments of DuckDB SQL that several oracles share."""

from __future__ import annotations

from orevein.functions import constants as K
from orevein.functions import places as P


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return f"[{quoted(values)}]"


def places(source: str, key: str, text: str, name: str = "places") -> str:
    """CTEs up to ``{name}({key}, places)``: the gazetteer's places in each text, by frequency, then first mention; no row without any."""
    pattern = r"\b(?:" + "|".join(P.LONGEST_FIRST).replace(".", r"\.") + r")\b"
    rows = ", ".join(f"({literal(a)}, {literal(p)})" for a, p in P.ALIASES.items())
    found = f"regexp_extract_all(lower({text}), {literal(pattern)})"
    return f"""{name}_alias(alias, place) AS (VALUES {rows}),
{name}_found AS (SELECT {key}, unnest({found}) AS alias, generate_subscripts({found}, 1) AS pos FROM {source}),
{name}_counted AS (SELECT {key}, place, count(*) AS n, min(pos) AS first FROM {name}_found JOIN {name}_alias USING (alias) GROUP BY ALL),
{name} AS (SELECT {key}, list(place ORDER BY n DESC, first) AS places FROM {name}_counted GROUP BY {key})"""


def stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= 3 THEN {t}[:length({t}) - {len(s)}]" for s in K.TERM_SUFFIXES)
    return f"CASE WHEN length({t}) > 4 THEN CASE {cases} ELSE {t} END ELSE {t} END"


def terms(text: str) -> str:
    pattern = K.TERM_PATTERN.replace("'", "''")
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{pattern}'), lambda t: NOT list_contains([{quoted(K.TERM_STOP_WORDS)}], t)), lambda t: {stem('t')})"


def answer_tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([{quoted(K.ANSWER_STOP_WORDS)}], t)))"


def bm25(where: str = "true", name: str = "bm25") -> str:
    """CTEs up to ``{name}(query_id, id, score)`` over documents and benchmark."""
    return f"""
d AS (SELECT doc_id AS id, lang, source, {terms("text")} AS terms FROM documents),
c AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
p AS (SELECT id, lang, source, len(terms) AS dl, unnest(terms) AS term FROM d),
tf AS (SELECT id, lang, source, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, sqrt(count(*)) AS qw FROM (SELECT item_id AS query_id, unnest({terms("text")}) AS term FROM benchmark) GROUP BY ALL),
{name} AS (
  SELECT query_id, id, sum(qw * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K.K1 + 1} / (tf + {K.K1} * (1 - {K.B} + {K.B} * dl / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), c WHERE {where} GROUP BY ALL)"""


DENSE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings),
dense AS (SELECT b.item_id AS query_id, e.vec_id AS id, list_dot_product(q.vector, e.vector) AS score
  FROM benchmark b JOIN v q ON q.vec_id = b.item_id, v e)"""


def top(source: str, k: int, score: str = "score") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM {source} QUALIFY rank <= {k})"


def f1(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {common} > 0 THEN round(2.0::DOUBLE * {common} / (len({a}) + len({b})), 4) ELSE 0.0 END"
