"""Links and classes of similar items that share a bucket, without emitting all pairs of a bucket.

Buckets come as rows ``bucket, item`` (an item is the hash of a distinct content, so copies fold in the
first aggregate). Buckets with the same members are one.

* First pass, in proportion to the rows: each item carries ``SIGNATURE`` MinHash values of its grams, buckets of
  more than ``BLOCK`` items are dealt into blocks twice, by two hashes, and each block gives a spanning forest of
  its most similar signatures. The pairs are verified and give classes, so a large group of near copies is
  one class from here on. What signatures miss is left to the second pass.
* Second pass, exact: buckets whose members lie in different classes are compared by their whole gram sets,
  all pairs of different classes inside the task, which gives out a spanning forest of the links it found.
  Classes that fill a block of a bucket get blocks of their own, which aren't compared with each other.

So two items that share a bucket and have the similarity end in one class, whatever their signatures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orevein.llm import words
from orevein.llm.components import connected_components
from orevein.operators.joins import small
from orevein.session import discard, materialize

SIGNATURE = 64
CUT = 0.7
BLOCK = 512
BLOCK_GRAMS = 1 << 20
_FACTORS = words.mix(np.arange(101, 101 + SIGNATURE, dtype=np.uint64)) | np.uint64(1)


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows ``bucket, item`` (distinct) of buckets with at least two different items; of buckets with the same items one.

    One shuffle: splitters over both columns cut a hot bucket across partitions, and a sorted sweep drops repeats and
    buckets of one item. What stands at the edge of a partition stays, since its bucket may go on in the next.
    """
    every = materialize(rows.select("bucket", "item"), "rows")  # read twice, for the splitters and by the sort
    some = materialize(every.repartitionByRange("bucket", "item").sortWithinPartitions("bucket", "item").mapInArrow(_several, "bucket long, item long"), "several", tidy=True)
    discard(every)
    h = F.xxhash64("item")
    sets = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("a"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("b"))
    shared = materialize(some.join(sets.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket"), "buckets")
    discard(some)
    return shared


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, item, out = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row, and whether it has been given out
    for batch in batches:
        b, i = (np.concatenate([held, batch.column(c).to_numpy()]) for held, c in ((bucket, "bucket"), (item, "item")))
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
        b, i = b[new], i[new]
        if not len(b):
            continue
        alike = b[1:] == b[:-1]
        keep = np.zeros(len(b), bool)
        keep[1:] |= alike
        keep[:-1] |= alike
        keep[0] |= not len(bucket)
        last, given = keep[-1] or (len(b) == 1 and out and len(bucket) > 0), keep.copy()
        given[0] &= not (len(bucket) and out)
        bucket, item, out = b[-1:], i[-1:], bool(last)
        yield pa.RecordBatch.from_arrays([pa.array(b[given]), pa.array(i[given])], names=["bucket", "item"])
    if len(bucket) and not out:
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(item)], names=["bucket", "item"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """16 bits of each MinHash value of the grams."""
    for batch in batches:
        grams = batch.column("grams")
        values = grams.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(grams).to_numpy(zero_copy_only=False))]).astype(np.int64)
        if not batch.num_rows:
            continue
        low = np.stack([words.mix(np.minimum.reduceat(values * f, offsets[:-1])) >> np.uint64(48) for f in _FACTORS], axis=1).astype("<u2")
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([row.tobytes() for row in low], pa.binary())], names=["item", "signature"])


def _forest(alike: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over pairs of at least ``least``."""
    n = len(alike)
    edges, left = [], np.ones(n, bool)
    best, parent = np.full(n, -1), np.zeros(n, np.int64)
    for _ in range(n):
        i = int(np.where(left, best, -2).argmax())
        if best[i] >= least:
            edges.append((int(parent[i]), i))
        left[i] = False
        closer = alike[i] > best
        best[closer], parent[closer] = alike[i][closer], i
    return edges


def _alike(table: pa.Table) -> list[tuple[int, int]]:
    """Pairs of one block by signatures."""
    item = table["item"].to_numpy()
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(len(item), SIGNATURE)
    alike = np.stack([(row == signature).sum(axis=1) for row in signature])
    return [(int(min(item[a], item[b])), int(max(item[a], item[b]))) for a, b in _forest(alike, round(CUT * SIGNATURE))]


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _linked(per_mille: int):
    """Links between different classes of one pair of blocks, by whole gram sets: a spanning forest of the classes."""

    def run(table: pa.Table) -> list[tuple[int, int]]:
        item, of_class, part = table["item"].to_numpy(), table["class"].to_numpy(), table["part"].to_numpy()
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        grams = table["grams"].combine_chunks()
        size = pa.compute.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        values, code = np.unique(grams.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        left = np.flatnonzero(part == x)
        right = left if x == y else np.flatnonzero(part == y)
        left, right = left[size[left] > 0], right[size[right] > 0]
        if not len(left) or not len(right):
            return []
        if len(left) > len(right):
            left, right = right, left
        theirs = code[words.ragged(ends[right], size[right])]
        starts = np.concatenate([[0], np.cumsum(size[right])[:-1]])
        parent, out, mark = {}, [], np.zeros(len(values), bool)
        for i in left:
            near = (of_class[right] != of_class[i]) & (np.minimum(size[right], size[i]) * 1000 >= np.maximum(size[right], size[i]) * per_mille)
            if not near.any():
                continue
            own = code[ends[i] : ends[i + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[theirs].astype(np.int64), starts)
            mark[own] = False
            # in integers, so that a similarity of just the threshold isn't lost to rounding
            for j in right[near & (common * 1000 >= (size[right] + size[i] - common) * per_mille)]:
                a, b = _root(parent, int(of_class[i])), _root(parent, int(of_class[j]))
                if a != b:
                    parent[a] = b
                    out.append((int(min(item[i], item[j])), int(max(item[i], item[j]))))
        return out

    return run


def _in_groups(keys: list[str], pairs_of: Callable[[pa.Table], list[tuple[int, int]]]):
    """``pairs_of`` of each group of equal ``keys`` in batches sorted by those."""

    def cuts(table: pa.Table) -> list[int]:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in keys:
            v = table[name].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new).tolist()

    def finish(table: pa.Table, at: list[int]) -> Iterator[pa.RecordBatch]:
        found = {p for a, b in zip(at[:-1], at[1:], strict=True) if b - a > 1 for p in pairs_of(table.slice(a, b - a))}
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = held and all(batch.column(k)[-1] == held[0].column(k)[0] for k in keys)
            held.append(batch)
            if same:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            at = cuts(table)
            yield from finish(table, at)
            rest = table.slice(at[-1])
            held = pa.Table.from_batches([b.take(pa.array(range(b.num_rows))) for b in rest.to_batches()]).to_batches()  # a copy: a slice would hold the whole table
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from finish(table, [*cuts(table), table.num_rows])
        words.trim()

    return run


def _forests(shared: DataFrame, grams: DataFrame) -> DataFrame:
    """First pass: distinct pairs ``a < b`` with like signatures."""
    hot = materialize(shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "hot")  # one of BLOCK rows at most
    dealt = shared.join(small(hot), "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    turn = F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("turn")
    rows = dealt.select("bucket", "item", "blocks", turn).select("bucket", "item", "turn", F.pmod(F.xxhash64("item", "bucket", "turn"), F.col("blocks")).cast("int").alias("block"))
    keys = ["bucket", "turn", "block"]
    signed = rows.join(grams.mapInArrow(_sign, "item long, signature binary"), "item")
    return signed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_groups(keys, _alike), "a long, b long").distinct()


def _across(shared: DataFrame, classes: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Second pass: links between different classes that share a bucket."""
    sizes = grams.select("item", F.size("grams").cast("long").alias("size")).join(classes, "item", "left")
    rows = shared.join(sizes.select("item", "size", F.coalesce("component", "item").alias("class")), "item")
    mixed = rows.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("bucket")
    rows = materialize(rows.join(mixed, "bucket", "left_semi"), "mixed")
    if not rows.take(1):
        return rows.select(F.col("item").alias("a"), F.col("item").alias("b"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_GRAMS)).cast("int")
    own = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).withColumn("own", blocks(F.col("n"), F.col("size")))
    large = own.filter("own > 1").select("bucket", "class", "own")
    small = own.filter("own = 1").groupBy("bucket").agg(blocks(F.sum("n"), F.sum("size")).alias("rest"))
    placed = rows.join(large, ["bucket", "class"], "left").join(small, "bucket", "left")
    alone = F.when(F.col("own").isNotNull(), F.col("class"))
    part = F.when(F.col("own").isNotNull(), F.xxhash64("class", F.pmod(F.xxhash64("item"), F.col("own")))).otherwise(F.pmod(F.xxhash64("class"), F.col("rest")))
    placed = materialize(placed.select("bucket", "item", "class", alone.alias("alone"), part.alias("part")), "placed")
    parts = placed.groupBy("bucket", "part").agg(F.max("alone").alias("alone"))
    other = parts.select("bucket", F.col("part").alias("with"), F.col("alone").alias("other"))
    pairs = parts.join(other, "bucket").filter(~F.coalesce(F.col("alone") == F.col("other"), F.lit(False)))
    groups = pairs.select("bucket", "part", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y")).distinct()
    keys = ["bucket", "x", "y"]
    whole = placed.select("bucket", "item", "class", "part").join(groups, ["bucket", "part"]).join(grams, "item")
    found = whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_groups(keys, _linked(round(similarity * 1000))), "a long, b long").distinct()
    found = materialize(found, "links")
    discard(rows, placed)
    return found


def link_classes(shared: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """``item, component`` of the items with a link (but the smallest of each class); ``grams`` holds ``item, grams`` of the shared items.

    Two items are linked if the Jaccard similarity of their gram sets is at least ``similarity``.
    """
    strong = materialize(_forests(shared, grams), "pairs")
    links = materialize(_verified(strong, grams, similarity), "links")
    discard(strong)
    classes = connected_components(links)
    more = _across(shared, classes, grams, similarity)
    out = connected_components(links.union(more)) if more.take(1) else classes
    discard(links, more)
    return out


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    left = grams.select(F.col("item").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("item").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("ga", "gb")))
    need = round(similarity * 1000)
    return both.filter(F.col("n") * 1000 >= (F.size("ga") + F.size("gb") - F.col("n")) * need).select("a", "b")


def fetch_grams(docs: DataFrame, owners: DataFrame, extract: Callable, key: str = "doc_id") -> DataFrame:
    """``item, grams`` of the items in ``owners`` (``key, item``), extracted again from the texts of those documents.

    ``extract`` maps batches of ``text, wanted`` (the document's items asked for) to batches of ``item, grams``.
    """
    wanted = owners.groupBy(F.col(key).alias("__own")).agg(F.collect_list("item").alias("wanted"))
    texts = docs.select(key, "text").join(wanted, F.col(key).eqNullSafe(F.col("__own")))
    rows = texts.select("text", "wanted").mapInArrow(extract, "item long, grams array<long>")
    return materialize(rows.dropDuplicates(["item"]), "grams")
