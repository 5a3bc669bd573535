"""Tables composed from the driver's: texts with phrases that name places, people, amounts and fields.

The driver's prose is invented words, in which the text operators would find next to nothing. So each row of
``documents`` or ``conversations`` gets a phrase picked by its number, and ``customer`` becomes profiles of one
template, one document a nation. Every view exists as a DataFrame and as SQL; nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.session import load

PHRASES = [
    "The candidate profile of Dr. Asha Rao says she is contesting from Guntur West.",
    "Our manifesto is a vision document: we pledge pension for old age and water for every farmer.",
    "Smt. Meena Devi spoke in Ongole, in Tenali and again in Ongole about roads.",
    "The Jagananna Vidya Deevena and the Pension Kanuka reach each beneficiary; the Pension Kanuka is a scheme.",
    "Press release, for immediate release: the harbour at Kakinada gets electricity and a bus station.",
    "nothing of note here",
    "Q1. Who is eligible?\nA1. Every  family.\nQ2: How do I apply?\nA2: At the mandal office\nin person.\nQuestion 3. When?\nAnswer 3. Now.",
    "My dear brothers and sisters, this speech is an address to the people of Nandyal and Kadiri.",
    "In Vijayawada and Hyderabad the Telugu Desam and the Congress Party promise a metro, an airport and jobs.",
    "literacy rate and population of the district profile of West Godavari; Mr. Ravi Kumar Gupta, M.A., agrees",
    "Rythu Bharosa Card, Grama Mission and Amma Vodi help students, teachers and the school at Warangal.",
    "The BJP and the TDP debate solar power in Vizag, Waltair and Visakhapatnam.",
    "poll promise, election manifesto",
]
FILES = ["notes.txt", "candidate_profile-2.md", "faq_page.html", "press-release.md", "guntur_district-info.md", "SCHEME list.pdf", ""]
UTTERANCES = [
    "hello", "Um, hi there!", "hello, what does the plan say about roads", "thank you so much", "tell me what can you do for me", "what do you know about the west seat",
    "who are you", "are you a real person", "how are you doing today", "can you hear me", "ok", "that's all for now", "good night", "", "help", "help with road repair in the north",
    "no thanks", "could you tell me who you are", "well, what about the pension", "and the amount?", "I'm from Vijayawada and I need a job", "what about schools there",
    "What are the assets of Dr. Asha Rao's family", "tell me about Ravi Kumar Gupta", "who stands for Guntur West", "is Meena Das from Hill Town", "please, um, tell me the current bill",
    "born on 14th October 1985?", "March 3, 2001 or 3/4/99", "assets of Rs. 76.4 lakh", "about 12 percent of 3.25", "in 1999 and 2012", "the candidate for North Hill assembly",
    "my district is Ongole, what about the road there", "when was she born", "which languages does Nagesh speak", "what are the priorities for the constituency", "describe the political career",
    "what did the MLA promise", "I live in hyd and my ration card is lost", "rythu bharosa, amma vodi and pension in Guntur or Tenali",
]
GIVEN = ["Asha", "Ravi", "Meena", "Kiran", "Lata", "Arun", "Nila", "Mohan"]
FAMILY = ["Rao", "Verma", "Gupta", "Das", "Menon"]
TITLES = ["Dr.", "Sri", "Smt."]
SEATS = ["North Hill", "South Bank", "Old Town"]
MONTHS = ["January", "May", "October"]
SHARES = 3


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: list[str], n: str) -> str:
    return f"({quoted(values)})[(({n}) % {len(values)} + 1)::INT]"




def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, text, file_name``: documents with a phrase and a file name."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(PHRASES, F.col("doc_id"))).alias("text"), pick(FILES, F.col("doc_id") + 1).alias("file_name"))


PAPERS = f"papers AS (SELECT doc_id, source, lang, coalesce(text, '') || chr(10) || {sql_pick(PHRASES, 'doc_id')} AS text, {sql_pick(FILES, 'doc_id + 1')} AS file_name FROM documents)"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, conv_id, turn, role, text``: of every turn a phrase, and of every third the turn's own text after it."""
    turns = load(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 7 + F.col("turn")
    phrase = pick(UTTERANCES, number)
    text = F.when(number % 3 == 0, F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")))).otherwise(phrase)
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn", "role", text.alias("text"))


_N = "conv_id * 7 + turn"
UTTERED = f"uttered AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, role, CASE WHEN ({_N}) % 3 = 0 THEN {sql_pick(UTTERANCES, _N)} || ' ' || coalesce(text, '') ELSE {sql_pick(UTTERANCES, _N)} END AS text FROM conversations)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, nation, place, given, family, title, seat, born, movable, immovable, liabilities`` of every customer; the balance gives the amounts."""
    customer, nation = load(spark, sf_dir, "customer", "nation")
    # narrow rows come in few splits, and long work on their records follows: every core gets a share
    customer = customer.select("c_custkey", "c_nationkey", "c_acctbal").repartition(SHARES * spark.sparkContext.defaultParallelism, "c_custkey")
    k = F.col("c_custkey")
    cents = F.abs(F.round(F.col("c_acctbal") * 100).cast("long"))
    amount = lambda n: F.concat((n / 10).cast("long").cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return rows.select(
        k.alias("key"),
        F.col("n_nationkey").alias("nation"),
        F.initcap("n_name").alias("place"),
        pick(TITLES, k).alias("title"),
        pick(GIVEN, k).alias("given"),
        F.concat(pick(FAMILY, F.floor(k / 3)), F.lit(" "), pick(FAMILY, F.floor(k / 40))).alias("family"),
        pick(SEATS, k).alias("seat"),
        F.concat((k % 28 + 1).cast("string"), F.lit(" "), pick(MONTHS, k), F.lit(" "), (k % 60 + 1930).cast("string")).alias("born"),
        amount(cents % 5000).alias("movable"),
        amount(cents % 77).alias("immovable"),
        amount(cents % 900).alias("liabilities"),
    )


_CENTS = "abs(round(c_acctbal * 100)::BIGINT)"
_AMOUNT = "(({0}) // 10)::VARCHAR || '.' || (({0}) % 10)::VARCHAR"
PEOPLE = f"""people AS (SELECT c_custkey AS key, n_nationkey AS nation, upper(n_name[1]) || lower(n_name[2:]) AS place0, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS place,
  {sql_pick(TITLES, "c_custkey")} AS title, {sql_pick(GIVEN, "c_custkey")} AS given, {sql_pick(FAMILY, "c_custkey // 3")} || ' ' || {sql_pick(FAMILY, "c_custkey // 40")} AS family, {sql_pick(SEATS, "c_custkey")} AS seat,
  (c_custkey % 28 + 1)::VARCHAR || ' ' || {sql_pick(MONTHS, "c_custkey")} || ' ' || (c_custkey % 60 + 1930)::VARCHAR AS born,
  {_AMOUNT.format(_CENTS + " % 5000")} AS movable, {_AMOUNT.format(_CENTS + " % 77")} AS immovable, {_AMOUNT.format(_CENTS + " % 900")} AS liabilities
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def profile(title: Column | str = "title") -> Column:
    """A person's record in the template, the heading first."""
    c = F.col
    return F.concat(
        c("title"), F.lit(" "), c("given"), F.lit(" "), c("family"), F.lit(" - "), c("seat"), F.lit(", "), c("place"), F.lit(" District\n"),
        c("title"), F.lit(" "), c("given"), F.lit(" "), c("family"), F.lit(" is the candidate for the "), c("seat"), F.lit(" assembly constituency in "), c("place"), F.lit(" district.\n"),
        F.lit("Born. "), c("born"), F.lit(", in "), c("place"), F.lit(".\nEducation. Degree of "), c("seat"), F.lit(" college.\nProfession. Farmer.\nPolitical career. First elected in "), c("place"), F.lit(".\n"),
        F.lit("Priorities for the constituency. Water for "), c("seat"), F.lit(" .\nAssets declaration. Movable assets Rs. "), c("movable"), F.lit(" lakh, immovable assets Rs. "), c("immovable"),
        F.lit(" crore, liabilities Rs. "), c("liabilities"), F.lit(" lakh.\nLanguages. Telugu, "), c("given"), F.lit("ish."),
    )


SQL_PROFILE = (
    "title || ' ' || given || ' ' || family || ' - ' || seat || ', ' || place || ' District' || chr(10) || title || ' ' || given || ' ' || family || ' is the candidate for the ' || seat || ' assembly constituency in ' || place || ' district.' || chr(10)"
    " || 'Born. ' || born || ', in ' || place || '.' || chr(10) || 'Education. Degree of ' || seat || ' college.' || chr(10) || 'Profession. Farmer.' || chr(10) || 'Political career. First elected in ' || place || '.' || chr(10)"
    " || 'Priorities for the constituency. Water for ' || seat || ' .' || chr(10) || 'Assets declaration. Movable assets Rs. ' || movable || ' lakh, immovable assets Rs. ' || immovable || ' crore, liabilities Rs. ' || liabilities || ' lakh.' || chr(10) || 'Languages. Telugu, ' || given || 'ish.'"
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, record`` and the fields of every person."""
    return people(spark, sf_dir).withColumn("record", profile())


PROFILES = f"{PEOPLE}, profiles AS (SELECT *, {SQL_PROFILE} AS record FROM people)"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: the profiles of a nation, a blank line between them, after a heading and a byline."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "record"))), lambda x: x["record"])
    return profiles(spark, sf_dir).groupBy(F.col("nation").cast("long").alias("doc_id")).agg(F.concat(F.lit("Candidate Profiles\n\nA byline of no import.\n\n"), F.array_join(lines, "\n\n")).alias("text"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, source``: the papers with their file names, and the books of profiles from number 1,000,000 on."""
    papers_ = papers(spark, sf_dir).select("doc_id", "text", F.col("file_name").alias("source"))
    books_ = books(spark, sf_dir).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("profiles.txt").alias("source"))
    return papers_.unionByName(books_)


BOOKS = f"{PROFILES}, books AS (SELECT nation::BIGINT AS doc_id, 'Candidate Profiles' || chr(10) || chr(10) || 'A byline of no import.' || chr(10) || chr(10) || string_agg(record, chr(10) || chr(10) ORDER BY key) AS text FROM profiles GROUP BY nation)"
