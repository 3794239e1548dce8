"""Integrity checks that come back as rows: rule, violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ivf import entry_ids


def _rule(name: str, df: DataFrame) -> DataFrame:
    """`df` has one row with the number of violations."""
    return df.select(F.lit(name).alias("rule"), F.col(df.columns[0]).cast("long").alias("violations"))


def dense(rows: DataFrame, key: str) -> DataFrame:
    """How far ids are from 0, 1, 2 and so on: gaps and repeats."""
    n, d = F.count("*"), F.countDistinct(key)
    return rows.agg((n - d + F.coalesce(F.max(key) + 1, F.lit(0)) - d + F.count(F.when(F.col(key) < 0, 1))).alias("n"))


def verify(docs: DataFrame, passages: DataFrame, embeddings: DataFrame | None = None, postings: DataFrame | None = None, border: int = 1) -> DataFrame:
    """Dense ids, each passage's document, an embedding for each passage, and an index entry for each embedding in each of its `border` lists."""
    rules = [
        _rule("document ids dense", dense(docs, "doc_id")),
        _rule("passage ids dense", dense(passages, "passage_id")),
        _rule("passages have documents", passages.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*"))),
    ]
    if embeddings is not None:
        rules.append(_rule("passages have embeddings", passages.join(embeddings.select("passage_id"), "passage_id", "left_anti").agg(F.count("*"))))
        rules.append(_rule("embeddings have passages", embeddings.join(passages.select("passage_id"), "passage_id", "left_anti").agg(F.count("*"))))
    if postings is not None:
        ids = entry_ids(postings).select("passage_id")
        of = embeddings if embeddings is not None else passages
        rules.append(_rule("index holds each row once", ids.groupBy("passage_id").count().where(F.col("count") > border).agg(F.count("*"))))
        rules.append(_rule("rows are in the index", of.join(ids, "passage_id", "left_anti").agg(F.count("*"))))
    return reduce(DataFrame.unionByName, rules)


def round_trip(source: DataFrame, stored: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """checked, missing and different: stored texts against their source."""
    both = source.select(key, F.col(text).alias("_a")).join(stored.select(key, F.col(text).alias("_b"), F.lit(True).alias("_in")), key, "left")
    return both.agg(F.count("*").alias("checked"), F.count(F.when(F.col("_in").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_in") & ~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("different"))
