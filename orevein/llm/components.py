"""Connected components of an undirected graph, by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins, all of which Spark combines or splits for hot
vertices; nothing is gathered on the driver but a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orevein.session import discard, materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``u, v``."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``item, component`` for every end of a link that isn't the smallest of its component; ``component`` is that smallest item."""
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        following = materialize(_star(edges), "edges")
        discard(edges)
        edges = following
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            out = edges.select(F.col("u").alias("item"), F.col("v").alias("component"))
            out._orevein_path = edges._orevein_path  # for ``discard``
            return out
        state = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
