"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: every source gets its weight's share of the budget, sources above ``max_epochs`` times
their size are clamped there and the excess is shared again by weight. Sorted by cap over weight,
the clamped sources are a prefix, so one pass of running sums gives what the rounds of sharing end at.

Sampling: a source takes ``whole`` repetitions of each document and a fraction of one more. Which
documents get the further one is fixed by ``md5(seed:doc_id)``: those below the source's cut. The
cut is found by a descent over three levels of the hash (two hex digits, two more, then single
hashes), so a source of any size is summed in partial aggregates and no source is sorted in one task;
the documents at the cut itself take just the words that are left, so a source's words meet its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orevein.operators.joins import small
from orevein.session import load, materialize

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", source.alias("skey"), word_count(F.col("text")).alias("size"), key.alias("hkey"))


def water_fill(sources: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: int) -> DataFrame:
    """``skey, source_size`` to ``skey, source_size, target``; one row a source, so the windows are small."""
    n = len(weights)
    ranked = sources.withColumn("r", F.row_number().over(Window.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("r") % n + 1).cast("int"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(budget)) * F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", level)
        .withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("first_free", F.min(F.when(~F.col("clamped"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "skey", "level"))).over(every)["level"])
        .select("skey", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first_free"))).alias("target"))
    )


def _crossing(sums: DataFrame, by: Column) -> DataFrame:
    """The entry of each source in which the running sum over ``by`` reaches what is still needed; ``need`` becomes the rest."""
    running = Window.partitionBy("skey").orderBy("step")
    before = F.sum("words").over(running) - F.col("words")
    return sums.withColumn("step", by).withColumn("before", before).filter("before < need and before + words >= need").withColumn("need", F.col("need") - F.col("before"))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``skey, cut, rest, at_cut``: hashes below ``cut`` are taken, those at it share ``rest`` of their ``at_cut`` words."""
    found = plan.filter("need > 0").select("skey", F.lit("").alias("step"), "need")
    for digits in (2, 4, 32):
        at = found.withColumnRenamed("skey", "at_key")
        inside = rows.join(small(at), (F.col("skey") == F.col("at_key")) & F.col("hkey").startswith(F.col("step")))
        sums = inside.groupBy("skey", "need", F.substring("hkey", 1, digits).alias("p")).agg(F.sum("size").alias("words"))
        crossed = _crossing(sums, F.col("p"))
        found = crossed.select("skey", "step", "need")
    return crossed.select("skey", F.col("step").alias("cut"), F.col("need").alias("rest"), F.col("words").alias("at_cut"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Measured rows (``doc_id, skey, size, hkey``) and one row a source with its target and its cut."""
    rows = materialize(_measured(docs, seed), "sizes")
    sources = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    target = water_fill(sources, weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = target.withColumn("whole", whole).withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "targets")
    return rows, materialize(plan.join(_cuts(rows, plan), "skey", "left").drop("need"), "cuts")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Null texts have size 0; null sources are one source, ranked last. Rows that repeat an identifier
    have the same hash, so both are taken or, at the cut, share its words in proportion. An empty table
    gives an empty result, a source without words a target of 0; other columns are ignored.
    """
    rows, plan = mix_plan(docs, **options)
    further = F.when(F.col("hkey") < F.col("cut"), F.col("size")).when(F.col("hkey") == F.col("cut"), F.expr("rest * size div at_cut")).otherwise(0)
    return rows.join(small(plan), "skey").select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + further).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed: each row as often as it is taken. Rows stay whole, so those at a source's cut are taken if that is nearer to the target."""
    columns = docs.columns
    plan = mix_plan(docs, **options)[1]
    key = F.md5(F.concat(F.lit(f"{options.get('seed', SEED)}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    cuts = plan.select(F.col("skey").alias("__skey"), F.col("whole").alias("__whole"), F.when(F.col("rest") * 2 >= F.col("at_cut"), F.concat("cut", F.lit("~"))).otherwise(F.col("cut")).alias("__cut"))
    times = F.col("__whole") + F.when(key < F.col("__cut"), 1).otherwise(0)
    joined = docs.withColumn("__skey", source).join(small(cuts), "__skey").withColumn("__times", times.cast("int"))
    return joined.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select(*columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


QUERIES = {"op4_source_mix": op4_source_mix}
SQL = {
    "op4_source_mix": r"""
WITH m AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS hkey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM m GROUP BY skey),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= weight * level AS clamped FROM l),
free AS (SELECT level AS free_level FROM f WHERE NOT clamped ORDER BY cap / weight, skey LIMIT 1),
t AS (SELECT skey, source_size, CASE WHEN clamped THEN cap ELSE least(cap, weight * free_level) END AS target FROM f LEFT JOIN free ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, round(target)::BIGINT - whole * source_size AS rest FROM p),
c AS (
  SELECT m.doc_id, m.size, q.source_size, q.target, q.whole, q.rest,
         (sum(m.size) OVER (PARTITION BY m.skey ORDER BY m.hkey))::BIGINT AS upto, (sum(m.size) OVER (PARTITION BY m.skey, m.hkey))::BIGINT AS here
  FROM m JOIN q USING (skey))
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - here < rest THEN (rest - (upto - here)) * size // here ELSE 0 END)::BIGINT AS taken
FROM c
"""
}
