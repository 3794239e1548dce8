"""Rules that turn ranked passages (query_id, rank, doc_id, score) into ranked documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "first_rank", "doc_id")))


def _grouped(passages: DataFrame) -> DataFrame:
    rank = F.coalesce(F.col("rank").cast("double"), F.lit(float("inf")))
    return passages.groupBy("query_id", "doc_id").agg(F.count("*").alias("occurrences"), F.sum(F.coalesce("score", F.lit(0.0))).alias("total_score"), F.min(rank).alias("first_rank"))


def by_occurrence(passages: DataFrame) -> DataFrame:
    return _numbered(_grouped(passages), F.desc("occurrences"))


def by_score_sum(passages: DataFrame) -> DataFrame:
    return _numbered(_grouped(passages).withColumn("total_score", F.round("total_score", 9)), F.desc("total_score"))


def by_best_passage(passages: DataFrame) -> DataFrame:
    return _numbered(_grouped(passages), F.asc("first_rank"))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"occurrence": by_occurrence, "score_sum": by_score_sum, "best_passage": by_best_passage}


def rank_documents(passages: DataFrame, ranking: str | Callable[[DataFrame], DataFrame] = "occurrence") -> DataFrame:
    return (RULES[ranking] if isinstance(ranking, str) else ranking)(passages)


def rerank(passages: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, k: Column | int) -> DataFrame:
    """Adds rerank_score by `scorer` (a function on DataFrames with query and passage_text), renumbers, cuts at k.

    Without a scorer the old order is cut at k. A pair that the scorer leaves null scores 0.
    """
    if scorer is None:
        return passages.withColumn("rerank_score", F.lit(None).cast("double")).where(F.col("rank") <= k)
    scored = scorer(passages).withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.col("rank"))
    return scored.withColumn("_new", F.row_number().over(order)).where(F.col("_new") <= k).drop("rank").withColumnRenamed("_new", "rank")


def lexical(pairs: DataFrame) -> DataFrame:
    """The default scorer: the share of the query's words that the passage has."""
    return pairs.withColumn("rerank_score", overlap(F.col("query"), F.col("passage_text")))
