"""Numbers that keep the order of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orevein.session import materialize

HEAD_CHARS = 64


def numbered(docs: DataFrame, bits: int = 63) -> DataFrame:
    """``doc_id, num, text``: ``num`` is a distinct number in the order of documents, ``doc_id`` itself where that is one of ``bits`` bits.

    Rows that repeat an identifier are ordered by text, null identifiers come last. The splitters of the sort hold
    at most ``HEAD_CHARS`` characters of a text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("different"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if found.n == found.different and (found.n == 0 or (found.lo >= 0 and found.hi < 1 << bits) or bits >= 63):
        return rows.select("doc_id", F.col("doc_id").alias("num"), "text")
    head = F.substring("text", 1, HEAD_CHARS)
    parted = rows.repartitionByRange(F.asc_nulls_last("doc_id"), head).sortWithinPartitions(F.asc_nulls_last("doc_id"), "text").withColumn("i", F.monotonically_increasing_id())
    parted = materialize(parted.select("doc_id", "text", F.shiftright("i", 33).alias("part"), F.col("i").bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "numbered")
    sizes = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return parted.join(F.broadcast(ahead), "part").select("doc_id", (F.col("ahead") + F.col("i")).alias("num"), "text")
