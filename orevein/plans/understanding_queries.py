"""Queries of query understanding and text helpers over composed utterances and papers (see ``composed``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orevein.functions import entities as E
from orevein.functions import intent as I
from orevein.functions import places as P
from orevein.functions import rewrite as R
from orevein.functions import text as T
from orevein.functions.literals import described, literals
from orevein.operators import answer, memory
from orevein.plans import composed as C
from orevein.plans import sqltext as S
from orevein.registry import query

lit = S.literal


def sql_regex(source: str, pattern: str, to: str, all_of: bool = True) -> str:
    return f"regexp_replace({source}, {lit(pattern)}, {lit(to)}{', ' + lit('g') if all_of else ''})"


# --- intents
def _sql_trimmed(text: str) -> str:
    out = f"trim(coalesce({text}, ''))"
    for _ in range(3):
        out = f"trim({sql_regex(out, I.FILLER, '')})"
    return sql_regex(out, r"\s+", " ")


def _sql_rule(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, {lit('(?i)' + pattern)}) THEN '{name}'" for name, pattern in I.INTENTS)
    return f"CASE WHEN len(regexp_split_to_array({column}, '\\s+')) <= {I.MAX_WORDS} THEN CASE {cases} END END"


INTENT_SQL = f"""spoken AS (SELECT id, {_sql_trimmed("text")} AS spoken FROM uttered),
bare AS (SELECT *, {sql_regex(sql_regex("spoken", I.LEAD_IN, "", False), "^[ ,.!?]+|[ ,.!?]+$", "")} AS bare FROM spoken),
intents AS (SELECT id, CASE WHEN spoken = '' THEN 'greeting' ELSE coalesce({_sql_rule("spoken")}, CASE WHEN length(bare) >= 2 THEN {_sql_rule("bare")} END, 'factual') END AS intent FROM bare)"""


@query("intent_route", f"WITH {C.UTTERED}, {INTENT_SQL} SELECT id, intent FROM intents")
def intent_route(spark, sf_dir):
    return C.utterances(spark, sf_dir).select("id", I.intent(F.col("text")).alias("intent"))


@query("canned_reply", f"WITH {C.UTTERED}, {INTENT_SQL} SELECT id, CASE intent {' '.join(f'WHEN {lit(k)} THEN {lit(v[0])}' for k, v in E.REPLIES.items())} END AS reply FROM intents")
def canned_reply(spark, sf_dir):
    first = {name: options[:1] for name, options in E.REPLIES.items()}
    return C.utterances(spark, sf_dir).select("id", E.reply_of(I.intent(F.col("text")), F.col("id"), first).alias("reply"))


# --- cleaning, expansion
def _sql_strip(source: str, signs: str) -> str:
    return sql_regex(source, f"^[{signs}]+|[{signs}]+$", "")


def _sql_bare(text: str) -> str:
    return sql_regex(sql_regex(text, R.POLITE, "", False), R.FILLERS, "")


_CLEANED = f"cleaned AS (SELECT *, CASE WHEN length({_sql_strip(sql_regex(_sql_bare('text'), r'\s{2,}', ' '), ' ,.-')}) >= 2 THEN {_sql_strip(sql_regex(_sql_bare('text'), r'\s{2,}', ' '), ' ,.-')} ELSE trim(text) END AS clean FROM uttered)"


@query("query_clean", f"WITH {C.UTTERED}, {_CLEANED} SELECT id, clean AS cleaned, regexp_matches(text, {lit(R.ORIGIN)}) AS origin FROM cleaned")
def query_clean(spark, sf_dir):
    return C.utterances(spark, sf_dir).select("id", R.cleaned(F.col("text")).alias("cleaned"), R.states_origin(F.col("text")).alias("origin"))


_SYNONYMS = ", ".join(f"({i}, {lit(term)}, {S.listed(more)})" for i, (term, more) in enumerate(R.SYNONYMS.items()))


@query(
    "synonym_expand",
    rf"""WITH {C.UTTERED}, {_CLEANED}, syn(i, term, more) AS (VALUES {_SYNONYMS}),
hit AS (SELECT id, i, unnest(more) AS word, generate_subscripts(more, 1) AS k FROM cleaned, syn WHERE regexp_matches(lower(clean), '\b' || term || '\b')),
one AS (SELECT id, word, min(i * 10 + k) AS first FROM hit GROUP BY ALL),
syns AS (SELECT id, string_agg(word, ' ' ORDER BY first) AS words FROM one GROUP BY id),
{S.places("cleaned", "id", "text")}
SELECT id, array_to_string(list_filter([CASE WHEN words IS NOT NULL THEN clean || ' ' || words END, CASE WHEN places IS NOT NULL AND NOT contains(lower(clean), lower(places[1])) THEN clean || ' ' || places[1] || ' district' END], lambda x: x IS NOT NULL), ' / ') AS variants
FROM cleaned LEFT JOIN syns USING (id) LEFT JOIN places USING (id)""",
)
def synonym_expand(spark, sf_dir):
    place = F.try_element_at(P.places(F.col("text")), F.lit(1))
    rows = C.utterances(spark, sf_dir).select("id", R.cleaned(F.col("text")).alias("clean"), place.alias("place"))
    return rows.select("id", F.array_join(R.expansions(F.col("clean"), F.col("place")), " / ").alias("variants"))


_FOLLOW = f"""{_CLEANED}, {INTENT_SQL}, {S.places("cleaned", "id", "clean")},
prior AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM uttered WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT *, last_value(CASE WHEN role <> 'user' AND before = 'user' THEN question END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM prior),
f AS (SELECT c.id, c.clean, p.last_user, coalesce(p.last_user IS NOT NULL AND i.intent = 'factual' AND (regexp_matches(c.clean, {lit(R.ELLIPTIC)}) OR (len(regexp_split_to_array(trim(c.clean), '\\s+')) <= 8 AND regexp_matches(c.clean, {lit(R.PRONOUNS)}) AND l.places IS NULL)), false) AS followup
  FROM cleaned c JOIN pairs p USING (id) JOIN intents i USING (id) LEFT JOIN places l USING (id)),
s AS (SELECT *, list_filter(string_split(trim({sql_regex(_sql_strip(_sql_bare("coalesce(last_user, '')"), " ,.?"), r"\s+", " ")}), ' '), lambda w: length(w) > 2)[:10] AS words, {_sql_strip(sql_regex("clean", R.ELLIPTIC, "", False), " ,.?")} AS rest FROM f),
effective AS (SELECT id, followup, CASE WHEN followup AND len(words) > 0 THEN CASE WHEN rest = '' THEN clean ELSE rest END || ' (regarding: ' || array_to_string(words, ' ') || ')' ELSE clean END AS q FROM s)"""


def _followed(spark, sf_dir):
    rows = C.utterances(spark, sf_dir).withColumn("clean", R.cleaned(F.col("text"))).withColumn("place", F.try_element_at(P.places(F.col("clean")), F.lit(1)))
    known = memory.with_last_question(rows.withColumnRenamed("conv_id", "session"))
    follow = R.is_followup(F.col("clean"), F.col("last_user").isNotNull(), I.intent(F.col("text")) != "factual", F.col("place"))
    known = known.withColumn("followup", F.coalesce(follow, F.lit(False)))
    return known.withColumn("q", F.when(F.col("followup"), R.spliced(F.col("clean"), F.col("last_user"))).otherwise(F.col("clean")))


@query("followup_splice", f"WITH {C.UTTERED}, {_FOLLOW} SELECT id, followup, q FROM effective")
def followup_splice(spark, sf_dir):
    return _followed(spark, sf_dir).select("id", "followup", "q")


@query(
    "needs_model",
    rf"WITH {C.UTTERED}, {_FOLLOW}, w AS (SELECT *, len(list_filter(regexp_split_to_array(q, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS n FROM effective) SELECT id, (followup AND NOT contains(q, 'regarding:')) OR n <= 3 OR (n <= 10 AND regexp_matches(q, {lit(R.PRONOUNS)})) AS needed FROM w",
)
def needs_model(spark, sf_dir):
    return _followed(spark, sf_dir).select("id", R.needs_model(F.col("q"), F.col("followup")).alias("needed"))


_KEY = r"lower(trim(regexp_replace(q, '\s+', ' ', 'g')))"


@query(
    "order_distinct",
    rf"""WITH {C.UTTERED}, {_CLEANED}, a AS (SELECT id, unnest([clean, lower(text), '  ' || clean, text, '']) AS q, generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM cleaned),
k AS (SELECT * FROM a WHERE trim(q) <> '' QUALIFY row_number() OVER (PARTITION BY id, {_KEY} ORDER BY i) = 1)
SELECT id, coalesce(out, '') AS out FROM uttered LEFT JOIN (SELECT id, string_agg(trim(q), '|' ORDER BY i) AS out FROM k GROUP BY id) USING (id)""",
)
def order_distinct(spark, sf_dir):
    rows = C.utterances(spark, sf_dir).withColumn("clean", R.cleaned(F.col("text")))
    every = F.array("clean", F.lower("text"), F.concat(F.lit("  "), "clean"), "text", F.lit(""))
    return rows.select("id", F.array_join(R.distinct_queries(every), "|").alias("out"))


# --- filters: the explicit ones come from the turn's number, the inferred ones from its text
GIVEN_PLACES = ["", "vizag", "near Ongole", "Atlantis", ""]
GIVEN_LISTS = ["", "", "", "hyd;guntoor;Nowhere", "tenali"]


@query(
    "apply_filters",
    f"""WITH {C.UTTERED}, {S.places("uttered", "id", "text")},
e AS (SELECT u.id, places, {C.sql_pick(GIVEN_PLACES, "u.id")} AS one, {C.sql_pick(GIVEN_LISTS, "u.id")} AS many, CASE WHEN u.id % 2 = 0 THEN 'faq' ELSE '' END AS category FROM uttered u LEFT JOIN places USING (id)),
r AS (SELECT *, CASE one WHEN 'vizag' THEN 'Visakhapatnam' WHEN 'near Ongole' THEN 'Prakasam' ELSE one END AS one2, CASE many WHEN 'tenali' THEN 'Guntur' WHEN '' THEN '' ELSE 'Hyderabad;Guntur;Nowhere' END AS many2 FROM e)
SELECT id, array_to_string(list_filter([CASE WHEN category <> '' THEN 'category=' || category END,
  CASE WHEN one2 <> '' AND many2 = '' THEN 'district=' || one2 WHEN one2 = '' AND many2 = '' AND places IS NOT NULL THEN 'district=' || places[1] END,
  CASE WHEN many2 <> '' THEN 'districts=' || many2 WHEN one2 = '' AND len(places) > 1 THEN 'districts=' || array_to_string(places[:3], ';') END], lambda x: x IS NOT NULL), ',') AS applied FROM r""",
)
def apply_filters(spark, sf_dir):
    named = P.places(F.col("text"))
    rows = C.utterances(spark, sf_dir).select(
        "id",
        F.create_map(F.lit("district"), C.pick(GIVEN_PLACES, F.col("id")), F.lit("districts"), C.pick(GIVEN_LISTS, F.col("id")), F.lit("category"), F.when(F.col("id") % 2 == 0, "faq").otherwise("")).alias("explicit"),
        named.alias("named"),
    )
    inferred = F.create_map(F.lit("district"), F.try_element_at("named", F.lit(1)), F.lit("districts"), F.when(F.size("named") > 1, F.array_join(F.slice("named", 1, 3), ";")))
    rows = rows.select("id", R.merged_filters(F.col("explicit"), inferred).alias("applied"))
    entries = F.array_sort(F.transform(F.map_entries("applied"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return rows.select("id", F.array_join(entries, ",").alias("applied"))


@query(
    "cache_namespace",
    f"""WITH {C.UTTERED}, n AS (SELECT id, conv_id, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS a, CASE WHEN turn % 3 = 0 THEN 'x' ELSE '' END AS b FROM uttered)
SELECT id, dense_rank() OVER (PARTITION BY conv_id ORDER BY (a = '' AND b = '') DESC, a, b) > 0 AS keyed, a = '' AND b = '' AS none, count(*) OVER (PARTITION BY conv_id, a, b) AS sharing FROM n""",
)
def cache_namespace(spark, sf_dir):
    """Whether the namespace is that of no filters, and how many turns of the conversation share it; filters are written in either order."""
    rows = C.utterances(spark, sf_dir)
    a, b = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""), F.when(F.col("turn") % 3 == 0, "x").otherwise("")
    one, other = F.create_map(F.lit("a"), a, F.lit("b"), b, F.lit("_t"), F.col("turn").cast("string")), F.create_map(F.lit("b"), b, F.lit("a"), a)
    keyed = rows.withColumn("key", E.cache_namespace(F.when(F.col("turn") % 4 < 2, one).otherwise(other)))
    return keyed.select("id", F.col("key").isNotNull().alias("keyed"), (F.col("key") == "_").alias("none"), F.count(F.lit(1)).over(Window.partitionBy("conv_id", "key")).alias("sharing"))


# --- values and people named in questions


@query("extract_literals")
def extract_literals(spark, sf_dir):
    return C.utterances(spark, sf_dir).withColumn("l", literals(F.col("text"))).select("id", described(F.col("l")).alias("found"), F.flatten(F.transform("l", lambda x: x["variants"])).alias("variants"))


@query("person_extract")
def person_extract(spark, sf_dir):
    return C.utterances(spark, sf_dir).select("id", E.person(F.col("text")).alias("person"))


# --- names of the people table
def _sql_tokens(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split(lower({c}), ' '), lambda w: regexp_replace(regexp_replace(regexp_replace(w, '^[.,]+|[.,]+$', '', 'g'), '''s$', ''), '^[.,]+|[.,]+$', '', 'g')), lambda w: length(w) > 1 AND NOT list_contains(['dr','sri','shri','smt','mr','mrs','ms','prof','kum'], w)))"


_ASKED_NAME = "CASE key % 4 WHEN 0 THEN title || ' ' || given || ' ' || family WHEN 1 THEN given || '  ' || family || '''s' WHEN 2 THEN family ELSE '' END"


@query("name_match_f1", f"WITH {C.PEOPLE}, n AS (SELECT p.key, {_ASKED_NAME.replace('key', 'p.key').replace('title', 'p.title').replace('given', 'p.given').replace('family', 'p.family')} AS a, o.title || ' ' || o.given || ' ' || o.family AS b FROM people p JOIN people o ON o.key = p.key + p.key % 3) SELECT key, {S.f1(_sql_tokens('a'), _sql_tokens('b'))} AS f1 FROM n")
def name_match_f1(spark, sf_dir):
    rows = C.people(spark, sf_dir)
    k, full = F.col("key") % 4, F.concat_ws(" ", "title", "given", "family")
    asked = F.when(k == 0, full).when(k == 1, F.concat("given", F.lit("  "), "family", F.lit("'s"))).when(k == 2, F.col("family")).otherwise("")
    other = rows.select(F.col("key").alias("with"), full.alias("b"))
    pairs = rows.select("key", asked.alias("a")).join(other, F.col("with") == F.col("key") + F.col("key") % 3)
    return pairs.select("key", T.name_f1(F.col("a"), F.col("b")).alias("f1"))


# --- texts for speech and screens
_MARKS = "'**Costs** of ' || source || ': Rs. 500 [1]. See [docs](http://x/' || doc_id || '), *now* .' || chr(10) || '# Head' || chr(10) || '- ' || coalesce(text, '') || chr(10) || chr(10) || '> a| b 🎉'"


def _marked(spark, sf_dir):
    rows = C.papers(spark, sf_dir)
    return rows.select("doc_id", F.concat(F.lit("**Costs** of "), "source", F.lit(": Rs. 500 [1]. See [docs](http://x/"), F.col("doc_id").cast("string"), F.lit("), *now* .\n# Head\n- "), "text", F.lit("\n\n> a| b 🎉")).alias("t"))


def _speech_sql(source: str) -> str:
    for pattern, to in T.SPEECH_RULES:
        source = sql_regex(source, pattern, to.replace("$1", r"\1"))
    return source


@query("speech_text", f"WITH {C.PAPERS}, m AS (SELECT doc_id, {_MARKS} AS t FROM papers) SELECT doc_id, {_speech_sql('t')} AS spoken FROM m")
def speech_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", T.speech_text(F.col("t")).alias("spoken"))


@query(
    "sanitized",
    rf"""WITH {C.PAPERS}, m AS (SELECT doc_id, ' <thinking>a</thinking> ' || {_MARKS} || '  `c`' AS t FROM papers)
SELECT doc_id, {sql_regex(sql_regex(sql_regex(sql_regex("t", E.LEAKED_TAGS, ""), r"(?m)(?:\*\*|__|`{1,3}|^#{1,6}\s+)", ""), r"[ \t]{2,}", " "), r"^\s+|\s+$", "")} AS out FROM m""",
)
def sanitized(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", E.sanitized(F.concat(F.lit(" <thinking>a</thinking> "), "t", F.lit("  `c`"))).alias("out"))


@query(
    "ssml",
    """WITH m AS (SELECT doc_id, replace(replace(replace(coalesce(text, '') || ' a < b & c', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, CASE WHEN doc_id % 2 = 0 THEN 'en-IN-A' ELSE 'te-IN-B:DragonHDLatestNeural' END AS v FROM documents)
SELECT doc_id, '<speak version="1.0" xml:lang="' || v[:5] || '"><voice name="' || v || '">' || CASE WHEN doc_id % 2 = 0 THEN '<prosody rate="0%">' || t || '</prosody>' ELSE t END || '</voice></speak>' AS out FROM m""",
)
def ssml(spark, sf_dir):
    from orevein.session import load

    voice = F.when(F.col("doc_id") % 2 == 0, "en-IN-A").otherwise("te-IN-B:DragonHDLatestNeural")
    return load(spark, sf_dir, "documents").select("doc_id", E.ssml(F.concat(F.coalesce("text", F.lit("")), F.lit(" a < b & c")), voice).alias("out"))


# --- fields of profiles
FIELD_QUESTIONS = [
    ("what are the assets", "Assets declaration"), ("which languages are spoken", "Languages"), ("hello there", None), ("describe the political career", "Political career"),
    ("what are the priorities for the seat", "Priorities for the constituency"), ("when was she born", "Born"), ("which college was it", "Education"), ("what is the occupation", "Profession"),
    ("who is the candidate for North Hill", "__summary__"), ("any court case", "Assets declaration"), ("any experience", "Political career"),
]


@query("field_intent", f"WITH {C.UTTERED} SELECT id, CASE {' '.join(f'WHEN regexp_matches(text, {lit(rf"(?i)\b(?:{p})")}) THEN {lit(label)}' for p, label in answer.FIELD_INTENTS)} END AS label FROM uttered")
def field_intent(spark, sf_dir):
    return C.utterances(spark, sf_dir).select("id", answer.field_intent(F.col("text")).alias("label"))


@query(
    "field_block",
    f"""WITH {C.PROFILES} SELECT key, 'Movable assets Rs. ' || movable || ' lakh, immovable assets Rs. ' || immovable || ' crore, liabilities Rs. ' || liabilities || ' lakh.' AS assets,
  born || ', in ' || place || '.' AS born, 'Telugu, ' || given || 'ish.' AS languages, NULL::VARCHAR AS missing, title || ' ' || given || ' ' || family || ' is the candidate for the ' || seat || ' assembly constituency in ' || place || ' district.' AS summary FROM profiles""",
)
def field_block(spark, sf_dir):
    record = F.col("record")
    block = lambda label: answer.field_block(record, label)
    return C.profiles(spark, sf_dir).select("key", block("Assets declaration").alias("assets"), block("Born").alias("born"), block("Languages").alias("languages"), block("Hobbies").alias("missing"), answer.summary_sentence(record).alias("summary"))


@query(
    "parse_record",
    f"""WITH {C.PROFILES} SELECT key, born, 'Degree of ' || seat || ' college' AS education, 'Farmer' AS profession, 'First elected in ' || place AS career, 'Water for ' || seat AS priorities, 'Telugu, ' || given || 'ish' AS languages, movable, immovable, liabilities, seat, place AS district FROM profiles""",
)
def parse_record(spark, sf_dir):
    return C.profiles(spark, sf_dir).select("key", answer.parsed_record(F.col("record")).alias("f")).select("key", "f.*")


@query(
    "field_totals",
    f"""WITH {C.PROFILES}, p AS (SELECT *, movable::DOUBLE AS m FROM profiles)
SELECT place AS district, count(*) AS records, max(m) AS highest, arg_min(key, (-m, key)) AS richest, round(sum(m), 4) AS total, count(DISTINCT seat) AS seats FROM p GROUP BY place""",
)
def field_totals(spark, sf_dir):
    """Aggregates across records, by the fields parsed from their texts."""
    parsed = C.profiles(spark, sf_dir).select("key", answer.parsed_record(F.col("record")).alias("f")).select("key", "f.district", "f.seat", F.col("f.movable").cast("double").alias("m"))
    return parsed.groupBy("district").agg(
        F.count(F.lit(1)).alias("records"), F.max("m").alias("highest"), F.min(F.struct((-F.col("m")).alias("n"), "key"))["key"].alias("richest"), F.round(F.sum("m"), 4).alias("total"), F.count_distinct("seat").alias("seats")
    )


@query("distinct_entities", f"WITH {C.PEOPLE} SELECT place, count(DISTINCT given || ' ' || family) AS entities, count(*) - count(DISTINCT given || ' ' || family) AS repeated, (SELECT count(*) FROM (SELECT 1 FROM people q WHERE q.place = p.place GROUP BY given, family HAVING count(*) > 1)) AS split FROM people p GROUP BY place")
def distinct_entities(spark, sf_dir):
    """Distinct people a place, and those spread over several records."""
    named = C.people(spark, sf_dir).groupBy("place", F.concat_ws(" ", "given", "family").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return named.groupBy("place").agg(F.count(F.lit(1)).alias("entities"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"), F.count_if(F.col("n") > 1).alias("split"))


@query("phrase_list", f"SELECT phrase FROM (VALUES {', '.join(f'({i}, {lit(p)})' for i, p in enumerate(E.STATIC_PHRASES))}, {', '.join(f'({100 + i}, {lit(p)})' for i, p in enumerate(x for place, names in P.GAZETTEER.items() for x in (place, *[n for n in names if len(n) > 4])))}) t(i, phrase) WHERE length(phrase) > 3 QUALIFY row_number() OVER (PARTITION BY lower(phrase) ORDER BY i) = 1 ORDER BY i LIMIT 500")
def phrase_list(spark, sf_dir):
    return E.phrase_list(spark)
