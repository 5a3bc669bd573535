"""The gazetteer and the places that texts name, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.functions.text import let, longest_of

# --- fixed values: places with their other names; of an alias listed twice the last place counts
GAZETTEER: dict[str, list[str]] = {
    "Anakapalli": ["anakapalli", "anakapalle"],
    "Ananthapuramu": ["ananthapuramu", "anantapur", "anantapuram", "hindupur", "kadiri", "guntakal"],
    "Annamayya": ["annamayya", "annamaiah", "rayachoti", "madanapalle", "madanapalli"],
    "Bapatla": ["bapatla", "chirala", "repalle", "parchur"],
    "Chittoor": ["chittoor", "chittor", "palamaner", "punganur"],
    "Dr. B.R. Ambedkar Konaseema": ["konaseema", "amalapuram", "ambedkar konaseema", "razole"],
    "East Godavari": ["east godavari", "rajahmundry", "rajamahendravaram", "kovvur", "nidadavolu"],
    "Eluru": ["eluru", "ellore", "chintalapudi", "polavaram"],
    "Guntur": ["guntur", "guntoor", "tenali", "mangalagiri", "ponnur", "tadikonda"],
    "Kakinada": ["kakinada", "cocanada", "pithapuram", "peddapuram", "samalkot"],
    "Krishna": ["krishna", "machilipatnam", "bandar", "gudivada", "pedana", "avanigadda"],
    "Kurnool": ["kurnool", "kurnul", "nandyal", "adoni", "yemmiganur"],
    "Nandyal": ["nandyal", "nandikotkur", "allagadda", "dhone"],
    "NTR": ["ntr district", "vijayawada", "bezawada", "vijaywada", "vijaywada city", "nandigama", "jaggayyapeta", "mylavaram", "tiruvuru"],
    "Palnadu": ["palnadu", "narasaraopet", "sattenapalle", "gurazala", "macherla", "vinukonda"],
    "Parvathipuram Manyam": ["parvathipuram", "manyam", "salur", "kurupam", "palakonda"],
    "Prakasam": ["prakasam", "ongole", "markapur", "kanigiri", "darsi", "addanki"],
    "Sri Potti Sriramulu Nellore": ["nellore", "spsr nellore", "kavali", "gudur", "atmakur", "sarvepalli"],
    "Sri Sathya Sai": ["sri sathya sai", "puttaparthi", "dharmavaram", "penukonda", "kadiri"],
    "Srikakulam": ["srikakulam", "chicacole", "palasa", "ichchapuram", "tekkali"],
    "Tirupati": ["tirupati", "tirumala", "srikalahasti", "sullurpeta", "satyavedu", "renigunta"],
    "Visakhapatnam": ["visakhapatnam", "vizag", "vishakhapatnam", "waltair", "gajuwaka", "bheemili"],
    "Vizianagaram": ["vizianagaram", "vizianagram", "bobbili", "nellimarla", "gajapathinagaram"],
    "West Godavari": ["west godavari", "bhimavaram", "narsapur", "narasapuram", "tadepalligudem", "tanuku", "palakollu"],
    "YSR Kadapa": ["kadapa", "cuddapah", "ysr kadapa", "proddatur", "pulivendula", "jammalamadugu"],
    "Alluri Sitharama Raju": ["alluri sitharama raju", "asr district", "paderu", "rampachodavaram", "chintapalle"],
    "Bapatla Rural": ["karlapalem"],
    "Hyderabad": ["hyderabad", "secunderabad", "charminar", "hyd"],
    "Rangareddy": ["rangareddy", "ranga reddy", "shamshabad", "ibrahimpatnam"],
    "Medchal-Malkajgiri": ["medchal", "malkajgiri", "kukatpally", "uppal"],
    "Warangal": ["warangal", "hanamkonda", "kazipet"],
    "Karimnagar": ["karimnagar", "jagtial", "huzurabad"],
    "Nizamabad": ["nizamabad", "bodhan", "armoor"],
    "Khammam": ["khammam", "kothagudem", "palvancha"],
    "Nalgonda": ["nalgonda", "miryalaguda", "devarakonda"],
}
SECOND_STATE = ("Hyderabad", "Rangareddy", "Medchal-Malkajgiri", "Warangal", "Karimnagar", "Nizamabad", "Khammam", "Nalgonda")
STATES = ("Andhra Pradesh", "Telangana")
ORIGIN_HINTS = (
    "i'm from", "im from", "i am from", "i live in", "i belong to", "i stay in", "we are from", "we're from",
    "my district", "my constituency", "my village", "my town", "my city", "from ", "in ", "at ",
)
ORIGIN_REACH = 60

#: lower-case alias (each place's own name included) to place
ALIASES: dict[str, str] = {alias: place for place, names in GAZETTEER.items() for alias in (place.lower(), *names)}
LONGEST_FIRST = sorted(ALIASES, key=lambda a: (-len(a), a))
PATTERN = rf"(?i)\b{longest_of(ALIASES)}\b"


def state_of(place: str) -> str:
    return STATES[place in SECOND_STATE]


def gazetteer(spark: SparkSession) -> DataFrame:
    """``alias, place, state``: one row an alias."""
    return spark.createDataFrame([(a, p, state_of(p)) for a, p in sorted(ALIASES.items())], "alias string, place string, state string")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def by_frequency(found: Column) -> Column:
    """The distinct entries of an array, the most frequent first, ties in the order of first appearance."""

    def ranked(every: Column) -> Column:
        return F.transform(F.array_distinct(every), lambda p, i: F.struct((-F.size(F.filter(every, lambda x: x == p))).alias("n"), i.alias("i"), p.alias("p")))

    return F.transform(F.array_sort(let(found, ranked)), lambda r: r["p"])


def places(text: Column) -> Column:
    """The places a text names, by frequency; aliases match as whole words in any case, the longest first."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0)), lambda a: F.element_at(_lookup(ALIASES), F.lower(a)))
    return by_frequency(found)


def place_of(name: Column) -> Column:
    """The place of a free-text name: that of the exact alias, else the first it mentions; null without any."""
    exact = F.try_element_at(_lookup(ALIASES), F.lower(F.trim(F.coalesce(name, F.lit("")))))
    return F.coalesce(exact, F.try_element_at(places(name), F.lit(1)))


def state(place: Column) -> Column:
    return F.when(place.isin(*SECOND_STATE), STATES[1]).when(place.isin(*GAZETTEER), STATES[0])


def stated_place(text: Column) -> Column:
    """The place an utterance gives: after the first phrase of origin that leads to one, else anywhere in it."""
    low = F.lower(text)

    def after(hint: str) -> Column:
        at = F.instr(low, hint)
        return F.when(at > 0, place_of(F.substr(text, at + len(hint), F.lit(ORIGIN_REACH))))

    return F.coalesce(*map(after, ORIGIN_HINTS), place_of(text))
