"""The training-data pipeline over ``documents``: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orevein.llm import bpe, exact_dedup, near_dedup, quality, source_mix
from orevein.session import load, materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null texts are scored as empty, and without any label all are kept at a score of 0.5."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside), that of the smallest number; rows that repeat number and text leave one."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest number; texts without a word are no copies of each other."""
    return near_dedup.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights; a null source is one of its own, a source without words keeps none."""
    return source_mix.repeat_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document, as often as it was taken; a null text has no tokens."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    Every stage takes rows as they come: nulls in any column, empty and very long texts, repeated numbers and rows, and
    columns of any name, which it hands on untouched; null numbers come last in every order. Empty tables give an empty
    result. The stages' own docstrings say what becomes of odd rows.
    """
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
