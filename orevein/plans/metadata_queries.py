"""Queries of places, categories, topics and the metadata of documents and chunks over composed papers (see ``composed``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orevein.functions import entities as E
from orevein.functions import places as P
from orevein.functions import signals as G
from orevein.functions import text as T
from orevein.operators import metadata as M
from orevein.plans import composed as C
from orevein.plans import sqltext as S
from orevein.registry import query
from orevein.session import load

lit = S.literal


def joined(c) -> F.Column:
    return F.array_join(c, "|")


# --- places
_PLACES = S.places("papers", "doc_id", "file_name || ' ' || text")


@query("doc_places", f"WITH {C.PAPERS}, {_PLACES} SELECT doc_id, coalesce(array_to_string(places, '|'), '') AS places FROM papers LEFT JOIN places USING (doc_id)")
def doc_places(spark, sf_dir):
    return C.papers(spark, sf_dir).select("doc_id", joined(P.places(F.concat("file_name", F.lit(" "), "text"))).alias("places"))


@query("place_mentions", f"WITH {C.PAPERS}, {S.places('papers', 'doc_id', 'text')} SELECT doc_id AS id, place, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM places_counted")
def place_mentions(spark, sf_dir):
    return E.mentions(C.papers(spark, sf_dir), P.gazetteer(spark), "doc_id")


NAMES = ["  VIZAG ", "near Ongole town", "Nandyal", "kadiri", "Atlantis", "", "Dr. B.R. Ambedkar Konaseema", "Tenali or Guntur or Eluru", "hyd"]
_NAMED = f"named AS (SELECT c_custkey, {C.sql_pick(NAMES, 'c_custkey')} AS name FROM customer)"
_STATE = f"CASE WHEN place IN ({S.quoted(P.SECOND_STATE)}) THEN {lit(P.STATES[1])} WHEN place IS NOT NULL THEN {lit(P.STATES[0])} END"


@query(
    "resolve_place",
    f"WITH {_NAMED}, {S.places('named', 'c_custkey', 'name')}, r AS (SELECT c_custkey, coalesce(a.place, places[1]) AS place FROM named LEFT JOIN places USING (c_custkey) LEFT JOIN places_alias a ON a.alias = lower(trim(name))) SELECT c_custkey, place, {_STATE} AS state FROM r",
)
def resolve_place(spark, sf_dir):
    place = P.place_of(C.pick(NAMES, F.col("c_custkey")))
    return load(spark, sf_dir, "customer").select("c_custkey", place.alias("place")).withColumn("state", P.state(F.col("place")))


@query("gazetteer_scan", f"WITH a(alias, place) AS (VALUES {', '.join(f'({lit(a)}, {lit(p)})' for a, p in P.ALIASES.items())}) SELECT place, count(*) AS aliases, {_STATE} AS state FROM a GROUP BY place")
def gazetteer_scan(spark, sf_dir):
    return P.gazetteer(spark).groupBy("place").agg(F.count(F.lit(1)).alias("aliases"), F.first("state").alias("state"))


_TAILS = " UNION ALL ".join(f"SELECT id, {i} AS pos, substr(text, instr(lower(text), {lit(h)}) + {len(h)}, {P.ORIGIN_REACH}) AS part FROM uttered WHERE contains(lower(text), {lit(h)})" for i, h in enumerate(P.ORIGIN_HINTS))
STATED = f"""tails AS ({_TAILS} UNION ALL SELECT id, 99, text FROM uttered), keyed AS (SELECT *, id * 100 + pos AS k FROM tails), {S.places("keyed", "k", "part")},
told AS (SELECT id, arg_min(coalesce(a.place, places[1]), pos) FILTER (coalesce(a.place, places[1]) IS NOT NULL) AS place FROM keyed LEFT JOIN places USING (k) LEFT JOIN places_alias a ON a.alias = lower(trim(part)) GROUP BY id)"""


@query("slot_update", f"WITH {C.UTTERED}, {STATED} SELECT u.id, told.place AS stated, last_value(told.place IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS slot FROM uttered u JOIN told USING (id)")
def slot_update(spark, sf_dir):
    """The place that a turn states, and the one its session holds from then on."""
    rows = C.utterances(spark, sf_dir).withColumn("stated", P.stated_place(F.col("text")))
    held = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", "stated", F.last("stated", ignorenulls=True).over(held).alias("slot"))


# --- categories, topics, parties
def _signals(table: dict[str, list[str]]) -> str:
    return ", ".join(f"({i}, {lit(own)}, {lit(s)})" for i, (own, signals) in enumerate(table.items()) for s in signals)


_QUESTIONS = r"len(regexp_extract_all(sample, '(?im)^\s*(?:Q\d*[.:)]|Question\s*\d*[.:])'))"
_CATEGORY = f"""csig(pos, category, sig) AS (VALUES {_signals(G.CATEGORIES)}),
csample AS (SELECT doc_id, substr(text, 1, 8000) AS sample, lower(file_name) AS name FROM papers),
cscore AS (SELECT doc_id, pos, category, sum(least(5, (length(sample) - length(replace(lower(sample), sig, ''))) // length(sig)) + CASE WHEN contains(name, sig) THEN 8 ELSE 0 END)
    + max(CASE WHEN contains(replace(replace(name, '_', ''), '-', ''), replace(category, '_', '')) THEN 12 ELSE 0 END) AS own, max({_QUESTIONS}) AS questions FROM csample, csig GROUP BY ALL),
cranked AS (SELECT doc_id, category, own + CASE WHEN category = 'faq' AND questions >= 3 THEN 3 * questions ELSE 0 END AS n, CASE WHEN category = 'faq' AND own = 0 THEN 99 ELSE pos END AS pos FROM cscore),
categories AS (SELECT doc_id, CASE WHEN n > 0 THEN category ELSE 'other' END AS category FROM cranked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1)"""


def _counted(table: dict[str, list[str]], name: str, source: str = "papers", key: str = "doc_id", text: str = "text") -> str:
    return f"""{name}_sig(pos, own, sig) AS (VALUES {_signals(table)}),
{name}_n AS (SELECT {key}, pos, own, sum((length({text}) - length(replace(lower({text}), sig, ''))) // length(sig))::BIGINT AS n FROM {source}, {name}_sig GROUP BY ALL),
{name} AS (SELECT {key}, list(own ORDER BY n DESC, pos) AS {name} FROM {name}_n WHERE n > 0 GROUP BY {key})"""


@query("doc_category", f"WITH {C.PAPERS}, {_CATEGORY} SELECT doc_id, category FROM categories")
def doc_category(spark, sf_dir):
    papers = C.papers(spark, sf_dir).withColumn("low", G.lowered(F.substring("text", 1, G.SAMPLE_CHARS)))
    return papers.select("doc_id", G.category(F.col("text"), F.col("file_name"), F.col("low")).alias("category"))


@query("doc_topics", f"WITH {C.PAPERS}, {_counted(G.TOPICS, 'topics')} SELECT doc_id, coalesce(array_to_string(topics[:4], '|'), '') AS topics FROM papers LEFT JOIN topics USING (doc_id)")
def doc_topics(spark, sf_dir):
    papers = C.papers(spark, sf_dir).withColumn("low", G.lowered(F.col("text")))
    return papers.select("doc_id", joined(G.topics(F.col("text"), low=F.col("low"))).alias("topics"))


@query("doc_party", f"WITH {C.PAPERS}, {_counted(G.PARTIES, 'parties')} SELECT doc_id, parties[1] AS party FROM papers LEFT JOIN parties USING (doc_id)")
def doc_party(spark, sf_dir):
    return C.papers(spark, sf_dir).select("doc_id", G.party(F.col("text")).alias("party"))


def _named(pattern: str, name: str, where: str, limit: int, source: str = "papers", key: str = "doc_id", text: str = "text") -> str:
    found = f"regexp_extract_all({text}, {lit(pattern)}, 1)"
    return f"""{name}_all AS (SELECT {key}, trim(regexp_replace(unnest({found}), '\\s+', ' ', 'g')) AS one, generate_subscripts({found}, 1) AS pos FROM {source}),
{name}_one AS (SELECT {key}, one, min(pos) AS pos FROM {name}_all WHERE {where} GROUP BY ALL),
{name} AS (SELECT {key}, list(one ORDER BY pos)[:{limit}] AS {name} FROM {name}_one GROUP BY {key})"""


_SCHEMES, _PEOPLE = _named(G.SCHEME, "schemes", "contains(one, ' ')", 8), _named(G.PERSON, "persons", "true", 6)


@query("doc_names", f"WITH {C.PAPERS}, {_SCHEMES}, {_PEOPLE} SELECT doc_id, coalesce(array_to_string(schemes, '|'), '') AS schemes, coalesce(array_to_string(persons, '|'), '') AS people FROM papers LEFT JOIN schemes USING (doc_id) LEFT JOIN persons USING (doc_id)")
def doc_names(spark, sf_dir):
    text = F.col("text")
    return C.papers(spark, sf_dir).select("doc_id", joined(G.schemes(text)).alias("schemes"), joined(G.people(text)).alias("people"))


def _hint_case() -> str:
    out = []
    for own, signals in G.CATEGORIES.items():
        long = [f"contains(lower(text), {lit(s)})" for s in signals if len(s) > G.LONG_SIGNAL]
        if long:
            out.append(f"WHEN {' OR '.join(long)} THEN {lit(own)}")
    return f"CASE {' '.join(out)} END"


@query(
    "query_hints",
    f"""WITH {C.UTTERED}, t(pos, topic, sig) AS (VALUES {_signals(G.TOPICS)}),
n AS (SELECT id, pos, topic, count(*) AS n FROM uttered, t WHERE contains(lower(text), sig) GROUP BY ALL),
b AS (SELECT id, topic FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) = 1)
SELECT u.id, {_hint_case()} AS category_hint, b.topic AS topic_hint FROM uttered u LEFT JOIN b USING (id)""",
)
def query_hints(spark, sf_dir):
    return C.utterances(spark, sf_dir).select("id", G.category_hint(F.col("text")).alias("category_hint"), G.topic_hint(F.col("text")).alias("topic_hint"))


# --- metadata of documents
_META = f"""{_PLACES}, {_CATEGORY}, {_counted(G.TOPICS, "topics")}, {_counted(G.PARTIES, "parties")}, {_SCHEMES}, {_PEOPLE},
meta AS (SELECT p.doc_id, c.category, coalesce(places, []) AS districts, places[1] AS place, coalesce(topics[:4], []) AS topics, parties[1] AS party, coalesce(schemes, []) AS schemes, coalesce(persons, []) AS persons,
  CASE WHEN c.category = 'candidate_profile' THEN persons[1] END AS candidate
  FROM papers p LEFT JOIN places USING (doc_id) LEFT JOIN categories c USING (doc_id) LEFT JOIN topics USING (doc_id) LEFT JOIN parties USING (doc_id) LEFT JOIN schemes USING (doc_id) LEFT JOIN persons USING (doc_id))"""


@query(
    "document_metadata",
    f"WITH {C.PAPERS}, {_META} SELECT doc_id, category, place AS district, array_to_string(districts, '|') AS districts, {_STATE} AS state, topics[1] AS topic, array_to_string(topics, '|') AS topics, candidate, party, array_to_string(schemes, '|') AS scheme_names, array_to_string(persons, '|') AS entities FROM meta",
)
def document_metadata(spark, sf_dir):
    meta = M.document_metadata(C.papers(spark, sf_dir))
    return meta.select("doc_id", "category", "district", joined("districts").alias("districts"), "state", "topic", joined("topics").alias("topics"), "candidate", "party", joined("scheme_names").alias("scheme_names"), joined("entities").alias("entities"))


GIVEN = ["", "vizag", "Atlantis", ""]


@query(
    "metadata_override",
    f"""WITH {C.PAPERS}, {_META},
g AS (SELECT *, CASE {C.sql_pick(GIVEN, "doc_id")} WHEN '' THEN NULL WHEN 'vizag' THEN 'Visakhapatnam' ELSE 'Atlantis' END AS given, CASE WHEN doc_id % 5 = 0 THEN 'water' END AS named FROM meta),
o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'speech' ELSE category END AS category, coalesce(given, place) AS district, CASE WHEN given IS NULL THEN districts ELSE [given] || list_filter(districts, lambda d: d <> given) END AS districts,
  CASE WHEN given = 'Atlantis' THEN NULL WHEN given IS NOT NULL THEN {lit(P.STATES[0])} ELSE {_STATE} END AS state, CASE WHEN named IS NULL THEN topics ELSE [named] || list_filter(topics, lambda t: t <> named) END AS topics FROM g)
SELECT doc_id, category, district, array_to_string(districts, '|') AS districts, state, topics[1] AS topic, array_to_string(topics, '|') AS topics FROM o""",
)
def metadata_override(spark, sf_dir):
    meta = M.document_metadata(C.papers(spark, sf_dir))
    out = M.override(meta, F.when(F.col("doc_id") % 7 == 0, "speech").otherwise(""), C.pick(GIVEN, F.col("doc_id")), F.when(F.col("doc_id") % 5 == 0, "water"))
    return out.select("doc_id", "category", "district", joined("districts").alias("districts"), "state", "topic", joined("topics").alias("topics"))


_PIECES = "pieces AS (SELECT p.*, doc_id * 100000 + g // 580 AS k, substr(text, (g + 1)::INT, 700) AS piece FROM papers p, LATERAL (SELECT unnest(generate_series(0, length(p.text) - 1, 580)) AS g) s)"


@query(
    "chunk_metadata",
    f"""WITH {C.PAPERS}, {_META}, {_PIECES}, {S.places("pieces", "k", "source || ' ' || piece", "own")}, {_counted(G.TOPICS, "ptopics", "pieces", "k", "piece")}, {_named(G.SCHEME, "pschemes", "contains(one, ' ')", 4, "pieces", "k", "piece")},
j AS (SELECT c.k, coalesce(own.places[1], m.place) AS place, coalesce(own.places, m.districts)[:8] AS districts, coalesce(ptopics[:3], m.topics)[:4] AS topics, coalesce(pschemes, m.schemes) AS schemes, m.persons[:5] AS persons
  FROM pieces c JOIN meta m USING (doc_id) LEFT JOIN own USING (k) LEFT JOIN ptopics USING (k) LEFT JOIN pschemes USING (k))
SELECT k, place AS district, array_to_string(districts, '|') AS districts, {_STATE} AS state, topics[1] AS topic, array_to_string(topics, '|') AS topics, array_to_string(schemes, '|') AS scheme_names, array_to_string(persons, '|') AS entities FROM j""",
)
def chunk_metadata(spark, sf_dir):
    meta = M.document_metadata(C.papers(spark, sf_dir)).withColumn("section_path", F.array("source"))
    columns = [c for c in meta.columns if c != "text"]
    pieces = meta.select(*columns, F.posexplode(T.char_windows(F.col("text"))).alias("no", "text"))
    out = M.chunk_metadata(pieces)
    return out.select((F.col("doc_id") * 100000 + F.col("no")).alias("k"), "district", joined("districts").alias("districts"), "state", "topic", joined("topics").alias("topics"), joined("scheme_names").alias("scheme_names"), joined("entities").alias("entities"))
