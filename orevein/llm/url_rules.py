"""URL rules by a sort-merge range join.

A host is written from its top-level label down (``net.example.``), so that a host with all its
subdomains is an interval of keys and the intervals of two hosts nest or are apart. Pages are
range-partitioned and sorted by that key; in each partition one sweep merges them with the sorted
rule intervals, holding the rules whose interval covers the current key on a stack. The longest rule
on the stack whose path starts the page's path decides. Rules are swept in blocks of at most
``BLOCK`` (so what a task is sent has a fixed bound); of several blocks' answers the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orevein.session import load

#: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCK = 20_000
DEFAULT = "allow"


def reversed_host(host: str) -> str:
    """``a.example.net`` to ``net.example.a.``: the closing dot keeps ``net.ex.`` out of the interval of ``net.e.``."""
    return ".".join(reversed(host.split("."))) + "."


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path columns; both are empty for null and for an url without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _sweep(rules: Sequence[tuple[str, str, str]]):
    """A function over sorted batches of ``page_id, host, path, key``."""
    by_key: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, host, path in rules:
        by_key.setdefault(reversed_host(host), []).append((len(host) + len(path), path, host + path, verdict))
    starts = sorted(by_key)
    for own in by_key.values():
        own.sort(key=lambda r: (-r[0], r[2]))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = 0, []
        for batch in batches:
            rule_col, verdict_col = [], []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
                while at < len(starts) and starts[at] <= key:  # open what starts before the page
                    while stack and not starts[at].startswith(stack[-1]):
                        stack.pop()
                    stack.append(starts[at])
                    at += 1
                while stack and not key.startswith(stack[-1]):  # close what ends before it
                    stack.pop()
                best = None
                for start in stack:
                    fit = next((r for r in by_key[start] if path.startswith(r[1])), None)
                    if fit and (best is None or fit[0] >= best[0]):
                        best = fit
                rule_col.append(best and best[2])
                verdict_col.append(best and best[3])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule_col, pa.string()), pa.array(verdict_col, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return sweep


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, block: int = BLOCK) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the page's path starts with the rule's; the longest
    rule (host and path together, then the deeper host) wins, else ``default`` holds. Null urls and urls
    without ``://`` have an empty host and path and so fit no rule. Repeated rows are judged each on its
    own, an empty table gives an empty result and other columns of ``pages`` are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    order = ["key", "path", "page_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "page_id long, host string, path string, rule string, verdict string"
    rules = sorted(set(rules), key=lambda r: reversed_host(r[1]))
    blocks = [rules[i : i + block] for i in range(0, len(rules), block)] or [[]]
    parts = [ordered.mapInArrow(_sweep(b), schema) for b in blocks]
    if len(parts) > 1:
        longest = F.max_by(F.struct("rule", "verdict"), F.struct(F.coalesce(F.length("rule"), F.lit(-1)), F.instr("rule", "/")))
        numbered = reduce(DataFrame.unionByName, parts)
        best = numbered.groupBy("page_id", "host", "path").agg(longest.alias("b"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("n"))
        parts = [best.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("page_id", "host", "path", "b.rule", "b.verdict")]
    return parts[0].withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(load(spark, sf_dir, "pages"))


QUERIES = {"op10_url_rules": op10_url_rules}
SQL = {
    "op10_url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (SELECT p.*, r.verdict, rhost || rpath AS rule,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""
}
