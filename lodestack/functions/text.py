"""Text expressions: tokens, chunks, filters and previews, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, space: str = "\\s+") -> Column:
    """Tokens between white space; none for null or blank."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), space), "")


def detokenized(parts: Column) -> Column:
    return F.array_join(parts, " ")


def n_chunks(n: Column, size: int, least_last: int) -> Column:
    """Chunks of `size` tokens; a last one under `least_last` joins the one before, and a lone one stays."""
    full, rest = F.floor(n / size), n % size
    return F.when(n == 0, 0).when(full == 0, 1).otherwise(full + F.when(rest >= least_last, 1).otherwise(0)).cast("int")


def chunk(parts: Column, index: Column, count: Column, size: int) -> Column:
    """Chunk `index` (from 0) of `count`; the last one takes what is left."""
    return F.slice(parts, index * size + 1, F.when(index == count - 1, F.greatest(F.size(parts) - index * size, F.lit(1))).otherwise(F.lit(size)))


def padded(ids: Column, length: int, fill: str = "") -> tuple[Column, Column]:
    """Cut or filled to `length`, and the mask (1 for a token, 0 for filling)."""
    n = F.least(F.size(ids), F.lit(length))
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(fill), length - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))


def enough_words(text: Column, least: Column) -> Column:
    """Off where `least` is null or not positive."""
    return least.isNull() | (least <= 0) | (F.size(tokens(text)) >= least)


def fetch_size(k: Column, min_words: Column, cap: int = 256) -> Column:
    """How many candidates to fetch so that about k are left after the word filter."""
    times = 1 + F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(min_words / 50)))
    return F.when(min_words.isNull() | (min_words <= 0), k).otherwise(F.least(F.lit(cap), k * times)).cast("int")


def preview(text: Column, n: int = 100) -> Column:
    return F.substring(text, 1, n)


def domain_of(name: Column) -> Column:
    """Base name, cut at `raw_passages`, then at `--`."""
    base = F.substring_index(name, "/", -1)
    return F.substring_index(F.substring_index(base, "raw_passages", 1), "--", 1)


def passage_file(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, "\\.jsonl$", ""), F.lit("_passages.jsonl"))


def embedding_file(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, "\\.jsonl$", ""), F.lit("_embeddings.parquet"))


def converted_file(folder: Column, part: Column) -> Column:
    return F.concat_ws("_", folder, F.concat(F.regexp_replace(part, "\\.parquet$", ""), F.lit(".jsonl")))


def overlap(query: Column, passage: Column) -> Column:
    """The default pair scorer: share of the query's distinct lower-case words that the passage has."""
    q, p = F.array_distinct(tokens(F.lower(query))), F.array_distinct(tokens(F.lower(passage)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(0.0)


def slot(text: Column, n: int, seed: int = 0) -> Column:
    """A number under n from a text's digest; any SQL engine can say the same."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 8), 16, 10).cast("long") % n).cast("int")
