"""Exact deduplication by a content sort.

Every text is normalised (each run of ASCII white space becomes one space) and the rows are
range-partitioned by ``(first 64 characters, SHA-256, identifier)``: sampled splitters of bounded
size spread the rows evenly, and a group of copies that holds a third of all rows is simply cut
across as many partitions as it fills. An external sort inside each partition puts equal texts next
to each other; neighbours are compared in full and the first of each run is its smallest identifier.
A run that crosses a partition edge is the last of one partition and the first of the next; those
edge runs (two a partition at most) are stitched by digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orevein.session import load, materialize

HEAD_CHARS = 64
#: Runs of two or more white-space bytes, or one that isn't a space: the same result as replacing every run, with few matches.
_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
_RUN_PY = re.compile(r"[ \t-\r]+")

_SCHEMA = "doc_id long, text_sha256 string, part int, edge boolean, first boolean, run_keep long, run_size long"


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of ``[\\x20\\x09-\\x0D]`` becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def _same(a: str | None, b: str | None) -> bool:
    return a == b or _RUN_PY.sub(" ", a or "") == _RUN_PY.sub(" ", b or "")


class _Runs:
    """Folds sorted batches into runs of equal texts; holds the identifiers of the open run only."""

    def __init__(self, part: int):
        self.part, self.ids, self.sha, self.text, self.at_start = part, [], None, None, True

    def close(self, last: bool) -> pa.RecordBatch | None:
        if self.sha is None:
            return None
        ids = pa.concat_arrays(self.ids)
        n = len(ids)
        out = pa.RecordBatch.from_arrays(
            [
                ids,
                pa.repeat(pa.scalar(self.sha), n),
                pa.repeat(pa.scalar(self.part, pa.int32()), n),
                pa.repeat(pa.scalar(self.at_start or last), n),
                pa.array([True] + [False] * (n - 1)),
                pa.repeat(pa.scalar(ids[0].as_py(), pa.int64()), n),
                pa.repeat(pa.scalar(n, pa.int64()), n),
            ],
            names=["doc_id", "text_sha256", "part", "edge", "first", "run_keep", "run_size"],
        )
        self.ids, self.sha, self.at_start = [], None, False
        return out

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, shas = batch.column("doc_id"), batch.column("text"), batch.column("text_sha256")
        n = len(ids)
        starts = [0]
        if n > 1:
            differ = pc.not_equal(shas[1:], shas[:-1])
            starts += [i + 1 for i in pc.indices_nonzero(differ).to_pylist()]
            equal = pc.fill_null(pc.equal(texts[1:], texts[:-1]), False)
            check = pc.indices_nonzero(pc.and_(pc.invert(differ), pc.invert(equal))).to_pylist()
            extra = [i + 1 for i in check if not _same(texts[i].as_py(), texts[i + 1].as_py())]
            if extra:
                starts = sorted(starts + extra)
        closed = []
        for k, start in enumerate(starts):
            end = starts[k + 1] if k + 1 < len(starts) else n
            joins = k == 0 and self.sha == shas[0].as_py() and _same(self.text, texts[0].as_py())
            if not joins:
                if (done := self.close(last=False)) is not None:
                    closed.append(done)
                self.sha = shas[start].as_py()
            self.ids.append(pc.add(ids.slice(start, end - start), 0))  # a copy: a slice would hold the whole batch, texts and all
        self.text = texts[n - 1].as_py()
        if closed:
            yield from pa.Table.from_batches(closed).combine_chunks().to_batches()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs(TaskContext.get().partitionId())
    for batch in batches:
        if batch.num_rows:
            yield from runs.feed(batch)
    if (rest := runs.close(last=True)) is not None:
        yield rest


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty and so form one group with the empty ones. Null identifiers come last,
    so such a row stays only if its whole group has none. Of rows repeated with the same identifier
    and text one stays. An empty table gives an empty result; other columns of ``docs`` are ignored,
    whatever their names.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.sha2(text, 256).alias("text_sha256"), F.substring(text, 1, HEAD_CHARS).alias("head"))
    order = ["head", "text_sha256", F.asc_nulls_last("doc_id")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", "text_sha256")
    runs = materialize(sorted_rows.mapInArrow(_runs, _SCHEMA), "runs")
    edges = (
        runs.filter("edge and first")
        .groupBy("text_sha256")
        .agg(F.min("run_keep").alias("edge_keep"), F.sum("run_size").alias("edge_size"), F.min("part").alias("edge_part"), F.count(F.lit(1)).alias("pieces"))
        .filter("pieces > 1")
    )
    # at most two rows a partition: a shuffle by digest would bring a hot group back into one task
    return runs.join(F.broadcast(edges), "text_sha256", "left").select(
        "doc_id",
        F.coalesce("edge_keep", "run_keep").alias("keep_id"),
        F.coalesce("edge_size", "run_size").alias("group_size"),
        (F.col("first") & (F.col("edge_part").isNull() | (F.col("part") == F.col("edge_part")))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies: of each group of equal texts the row with the smallest ``doc_id`` stays, all columns as they were."""
    decided = exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return keep_rows(docs, decided, F.sha2(normalised(F.col("text")), 256))


def keep_rows(docs: DataFrame, decided: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` that ``decided(doc_id, digest, kept)``, one row for each of them, keeps.

    Of rows that agree in ``doc_id`` and ``digest`` as many stay as are kept there; which of them is open. Such
    repeats are looked for in the narrow table first, so that texts are not sorted for a window when there are none.
    """
    totals = decided.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("m"), F.count_if("kept").alias("n")).filter("n > 0")
    totals = materialize(totals.toDF("__id", "__kept_digest", "__rows", "__kept"), "kept")
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id").cast("long").alias("__own"), digest.alias("__digest"))
    joined = own.join(totals, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept_digest")))
    if totals.filter("__rows > __kept").take(1):
        repeats = Window.partitionBy("__own", "__digest").orderBy("__own")
        joined = joined.withColumn("__n", F.row_number().over(repeats)).filter("__n <= __kept")
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
SQL = {
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
}
