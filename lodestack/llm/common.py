"""What the operators share: scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_dir, shared_path, table, written  # noqa: F401

#: ASCII white space, which parts words in every operator here.
SPACE = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The runs of characters that are not ASCII white space; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def bucket(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def running_most(x: Column, block: int = 256) -> Column:
    """Running maxima of an array of whole numbers; in blocks, so that long arrays are not copied per element."""
    top = lambda a, y: F.concat(a, F.array(F.greatest(F.element_at(a, -1), y)))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))
    bases = F.aggregate(F.transform(parts, F.array_max), F.array(F.element_at(x, 1)), top)
    runs = F.zip_with(bases, parts, lambda b, p: F.when(p.isNotNull(), F.slice(F.aggregate(p, F.array(b), top), 2, block)))
    return F.flatten(F.filter(runs, lambda r: r.isNotNull()))


def redacted_text(t: Column, spans: Column) -> Column:
    """`t` with each stretch of overlapping spans (start, end, tag) replaced by the tag of its first; `spans` is in order and not empty.

    The text is taken apart into characters once, so the cost is the text's length and the number of spans.
    """
    reach = lambda s: F.concat(F.array(F.lit(0)), running_most(F.transform(s, lambda x: x["end"])))
    pair = lambda x, before: F.struct(before.alias("before"), x["start"].alias("start"), x["tag"].alias("tag"))
    pieces = lambda c, s, m: F.transform(F.filter(F.zip_with(s, F.slice(m, 1, F.size(s)), pair), lambda p: p["start"] >= p["before"]), lambda p: F.concat(F.array_join(F.slice(c, p["before"] + 1, p["start"] - p["before"]), ""), p["tag"]))
    # One-element arrays hold what is used more than once, so that it is made once.
    parts = F.struct(F.filter(F.split(t, ""), lambda c: c != "").alias("c"), spans.alias("s"), reach(spans).alias("m"))
    whole = lambda p: F.concat(F.array_join(pieces(p["c"], p["s"], p["m"]), ""), F.array_join(F.slice(p["c"], F.element_at(p["m"], -1) + 1, F.size(p["c"])), ""))
    return F.element_at(F.transform(F.array(parts), whole), 1)
