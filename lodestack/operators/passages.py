"""Passages: token-bounded slices of documents, with a dense id in (document, chunk) order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow_text import cut
from .ids import running_sums


def passages(docs: DataFrame, size: int = 128, least_last: int = 64, tokenize: Callable[[Column], Column] = T.tokens, detokenize: Callable[[Column], Column] = T.detokenized) -> DataFrame:
    """doc_id, chunk_index, n_tokens, text and the other columns of `docs`. An empty or null text gives none.

    `tokenize` and `detokenize` map columns; a model's own tokenizer goes in as an Arrow user function.
    """
    # One-element arrays hold what is used more than once, so that it is made once; rows get their own tokens, never the text's.
    cuts = lambda t, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), T.chunk(t, i, n, size).alias("part")))
    parts = F.transform(F.array(tokenize(F.col("text"))), lambda t: F.filter(F.array(F.struct(t.alias("t"), T.n_chunks(F.size(t), size, least_last).alias("n"))), lambda x: x["n"] > 0))
    parts = F.flatten(F.transform(F.flatten(parts), lambda x: cuts(x["t"], x["n"])))
    # An outer explode: before another one Spark tests the array at the scan, and would make it twice.
    rows = docs.drop("text").columns
    found = docs.select(*(F.col(f"`{c}`") for c in rows), F.explode_outer(parts).alias("_cut")).where("_cut is not null")
    part = F.col("_cut.part")
    return found.select(*(F.col(f"`{c}`") for c in rows), F.col("_cut.index").alias("chunk_index"), F.size(part).alias("n_tokens"), detokenize(part).alias("text"))


def passages_by_batch(docs: DataFrame, size: int = 128, least_last: int = 64) -> DataFrame:
    """`passages` by the tokens of `functions.text.tokens`, a batch of texts at a time, for builds over whole corpora."""
    kept = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, index, n, text = cut(b.column(0), size, least_last)
            of = pa.array(row)
            columns = [*(c.take(of) for c in b.columns[1:]), pa.array(index.astype(np.int32)), pa.array(n.astype(np.int32)), text]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[1:], "chunk_index", "n_tokens", "text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.select("text", *(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, ", ".join([*kinds, "chunk_index int, n_tokens int, text string"]))


def passage_starts(docs: DataFrame, size: int = 128, least_last: int = 64, tokenize: Callable[[Column], Column] = T.tokens, first: int = 0) -> DataFrame:
    """doc_id, n (its passages) and start (`first` and those of all documents before it). Texts are counted where they lie; only ids and counts move."""
    counts = docs.select("doc_id", chunk_count(F.col("text"), size, least_last, tokenize).alias("n"))
    return running_sums(counts, ["doc_id"], "n", start=first)


def passage_table(docs: DataFrame, size: int = 128, least_last: int = 64, tokenize: Callable[[Column], Column] = T.tokens, first: int = 0, **how) -> DataFrame:
    """`passages` with passage_id, from `first` without gaps, in the order of (doc_id, chunk_index); doc_id is unique."""
    begun = passage_starts(docs, size, least_last, tokenize, first).select("doc_id", F.col("start").alias("_start"))
    rows = passages(docs.join(begun, "doc_id"), size, least_last, tokenize, **how)
    return rows.withColumn("passage_id", F.col("_start") + F.col("chunk_index")).drop("_start")


def chunk_count(text: Column, size: int = 128, least_last: int = 64, tokenize: Callable[[Column], Column] = T.tokens) -> Column:
    """How many passages a text gives."""
    made = F.transform(F.array(F.size(tokenize(text))), lambda n: T.n_chunks(n, size, least_last))  # the text is taken apart once
    return F.element_at(made, 1).cast("long")


def numbered(docs: DataFrame, start: str, size: int = 128, least_last: int = 64, **how) -> DataFrame:
    """`passages` with passage_id, of documents that know where theirs begin (column `start`, which is dropped). Nothing is shuffled."""
    cuts = passages(docs, size, least_last, **how) if how else passages_by_batch(docs, size, least_last)
    return cuts.withColumn("passage_id", F.col(start) + F.col("chunk_index")).drop(start)


def per_file(rows: DataFrame, file: str = "file_id") -> DataFrame:
    """Rows per file with the running total over files in order."""
    from pyspark.sql import Window

    counts = rows.groupBy(file).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, 0)))
