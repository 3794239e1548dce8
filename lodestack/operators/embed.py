"""Embeddings: a plug point for batch encoders, with a deterministic default that counts hashed tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_text import split
from ..functions.digests import md5_heads
from ..sources.catalog import not_done, write_store

#: Takes batches with the key and `text` and gives batches with the key and `embedding`.
Encoder = Callable[[Iterator], Iterator]


def hashed(batches: Iterator[pa.RecordBatch], dim: int, max_length: int | None, seed: int = 0) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens of each text (first column) by `slot`, at unit length; zeros for a text without tokens."""
    for b in batches:
        n, tokens = split(b.column(0))
        row = np.repeat(np.arange(b.num_rows), n)
        if max_length is not None:
            first = np.arange(len(row)) - (np.cumsum(n) - n)[row] < max_length
            row, tokens = row[first], tokens.filter(pa.array(first))
        coded = tokens.dictionary_encode()  # a token is digested once in a batch
        at = (md5_heads(coded.dictionary, b"%d:" % seed) % dim).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        out = np.bincount(row * dim + at, minlength=b.num_rows * dim).astype(np.float64).reshape(-1, dim)
        out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)
        flat = pa.array(out.astype(np.float32).ravel())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat)], [*b.schema.names[1:], "embedding"])


def embed(rows: DataFrame, key: str = "passage_id", encoder: Encoder | None = None, dim: int = 64, max_length: int | None = None, output: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, embedding and the columns `carry`. The default counts all hashed tokens, or the first `max_length`, and scales to unit length.

    A caller's encoder need not know of `carry`: what it leaves out is joined back by key.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, *carry)}
    if encoder is not None:
        found = rows.select(key, "text").mapInPandas(encoder, f"{key} {kinds[key]}, {output} array<float>")
        return found.join(rows.select(key, *carry), key) if carry else found
    picked = rows.select(F.col("text").cast("binary").alias("_text"), key, *carry)
    return picked.mapInArrow(lambda batches: hashed(batches, dim, max_length), ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", {output} array<float>").select(key, output, *carry)


def embed_missing(passages: DataFrame, store: str, overwrite: bool = False, **how) -> None:
    """Embeds the files that the store at `store` lacks (or all of them), one folder per file_id."""
    from ..sources.catalog import table_exists

    spark = passages.sparkSession
    todo = not_done(passages, spark.read.parquet(store), "file_id", overwrite) if table_exists(spark, store) else passages
    write_store(embed(todo, carry=("file_id",), **how), store, "file_id", "overwrite")


def embed_again(passages: DataFrame, store: str, file_ids: list[int], **how) -> None:
    """Replaces the embeddings of the files named and leaves the others."""
    write_store(embed(passages.where(F.col("file_id").isin(file_ids)), carry=("file_id",), **how), store, "file_id", "overwrite")
