"""Lookups by dense id: equi-joins that say what was not found, over tables or over stores that read only the folders of the ids asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import read_note, write_note

SPAN = 1_000_000


@dataclass
class RangedStore:
    """A table in folders of `span` ids each, column `_span`; within a folder, one file in the order of ids."""

    rows: DataFrame
    key: str
    span: int

    def near(self, ids: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of folders that hold an id of `ids`. Spark prunes the others at run time by a broadcast of folder numbers, of which there are ids / span at most."""
        spans = ids.select(F.floor(F.col(key or self.key) / self.span).cast("long").alias("_span")).distinct().where("_span >= 0")
        return self.rows.join(F.broadcast(spans), "_span").drop("_span")


def write_ranged(rows: DataFrame, path: str, key: str, span: int = SPAN) -> RangedStore:
    """Writes a table for lookups by `key`, a long from 0 on; rows without one are left out. A task holds the sort of one folder's rows, `span` where ids are unique."""
    spark = rows.sparkSession
    dealt = rows.where(F.col(key) >= 0).withColumn("_span", F.floor(F.col(key) / span).cast("long")).repartition("_span").sortWithinPartitions("_span", key)
    dealt.write.mode("overwrite").partitionBy("_span").parquet(path)
    write_note(spark, f"{path}/_span.json", {"key": key, "span": span})
    return read_ranged(spark, path)


def read_ranged(spark: SparkSession, path: str) -> RangedStore:
    note = read_note(spark, f"{path}/_span.json")
    if note is None:
        raise ValueError(f"{path} is not whole")
    return RangedStore(spark.read.parquet(path), note["key"], note["span"])


def near(table: DataFrame | RangedStore, ids: DataFrame, key: str) -> DataFrame:
    """`table`, or of a ranged store what may hold `ids`."""
    return table.near(ids, key) if isinstance(table, RangedStore) else table


def passages_by_id(ids: DataFrame, passages: DataFrame | RangedStore, key: str = "passage_id") -> DataFrame:
    """Passages of `ids`, each with the caller's columns (its position, say); ids without a passage are dropped."""
    return ids.join(near(passages, ids, key), key)


def lost_ids(ids: DataFrame, passages: DataFrame | RangedStore, key: str = "passage_id") -> DataFrame:
    return ids.join(near(passages, ids, key).select(key), key, "left_anti")


def documents_of(passages: DataFrame, docs: DataFrame | RangedStore) -> DataFrame:
    """Many to one: each passage with its document's columns."""
    return passages.join(near(docs, passages, "doc_id"), "doc_id")


def documents_by_id(requests: DataFrame, docs: DataFrame | RangedStore, text: str = "text") -> DataFrame:
    """doc_id, status (found or not_found) and text of each requested id."""
    known = near(docs, requests, "doc_id").select("doc_id", F.col(text).alias("doc_text"), F.lit("found").alias("_status"))
    return requests.join(known, "doc_id", "left").withColumn("status", F.coalesce("_status", F.lit("not_found"))).drop("_status")
