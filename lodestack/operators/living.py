"""An index that changes while it is searched: batches of postings come, are merged and go, and entries are taken out.

A store is a folder with `postings` (a folder per batch and list, as `ivf.write_postings` makes them), `deletes` (a table per change: of
posting blocks, the places of entries that no longer count) and `versions`: one small file per version that names the live batches and
deletes. A change writes its tables first and becomes visible by the next version's file, which is put in place by a rename that
fails where the name is taken; then the change is tried on the newer version. So a reader has whole batches, and an older version
stays readable until `vacuum` takes away what no kept version names.

Batches have levels. When `fan` batches of a level are live, `compact` makes one of the next level from them, without the entries that were taken
out. A batch is thus rewritten once a level, and the number of live batches, and of files, grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, written
from ..sources.catalog import delete, names_below, read_note, write_note
from . import ivf

FAN = 8
EMPTY = {"version": 0, "batches": [], "deletes": [], "streams": {}}


class Changed(Exception):
    """What a change was made from is no longer live."""


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in names_below(spark, f"{path}/versions") if n.endswith(".json") and not n.startswith("."))


def current(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version (the newest by default) names."""
    known = versions(spark, path)
    if version is None and not known:
        return EMPTY
    note = read_note(spark, f"{path}/versions/{known[-1] if version is None else version:012d}.json")
    if note is None:
        raise ValueError(f"no version {version}")
    return note


def commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> dict:
    """Makes the version after the newest one, by `change` of it; None changes nothing."""
    while True:
        now = current(spark, path)
        after = change({**now, "streams": dict(now["streams"])})
        if after is None:
            return now
        after["version"] = now["version"] + 1
        if write_note(spark, f"{path}/versions/{after['version']:012d}.json", after):
            return after


def _batches(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Postings of the batches named, with their batch; folders of other batches are not looked at."""
    if not names:
        return spark.createDataFrame([], f"{ivf.POSTINGS}, batch string")
    rows = spark.read.schema(f"{ivf.POSTINGS}, batch string").option("basePath", f"{path}/postings").parquet(*(f"{path}/postings/batch={n}" for n in names))
    return rows.select("list_id", "domain", "passage_ids", "codes", "batch")


def _posted(spark: SparkSession, path: str, names: list[str], deletes: list[dict]) -> DataFrame:
    rows = _batches(spark, path, names)
    of = [d["name"] for d in deletes if set(d["batches"]) & set(names)]
    if not of:
        return rows.withColumn("dead", F.lit(None).cast("array<int>"))
    gone = spark.read.parquet(*(f"{path}/deletes/{n}" for n in of)).groupBy("batch", "list_id", "first").agg(F.array_distinct(F.flatten(F.collect_list("dead"))).alias("dead"))  # a block's places
    return rows.withColumn("first", F.element_at("passage_ids", 1)).join(gone, ["batch", "list_id", "first"], "left").drop("first")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The postings of a version, for `ivf.search`, `ivf.entry_ids` and `verify`; dead entries are marked, and count for none of them."""
    now = current(spark, path, version)
    return _posted(spark, path, [b["name"] for b in now["batches"]], now["deletes"])


def _write(postings: DataFrame, path: str, name: str, level: int = 0) -> list[dict]:
    """Writes a batch; what a version is to say of it, which is nothing where there are no postings."""
    spark = postings.sparkSession
    delete(spark, f"{path}/postings/batch={name}")
    ivf.write_postings(postings, f"{path}/postings", name)
    return [{"name": name, "level": level}] if f"batch={name}" in names_below(spark, f"{path}/postings") else []


def add(spark: SparkSession, path: str, embeddings: DataFrame, q: ivf.Quantiser, domain: str | None = None, stream: str | None = None, number: int = 0) -> dict:
    """A batch of vectors that the index does not have yet. Batch `number` of a `stream` counts once, whatever is repeated."""
    if stream is not None and current(spark, path)["streams"].get(stream, -1) >= number:
        return current(spark, path)
    name = uuid.uuid4().hex if stream is None else f"{stream}-{number}"
    new = _write(ivf.encode(embeddings, q, domain), path, name)

    def change(now: dict) -> dict | None:
        if stream is not None:
            if now["streams"].get(stream, -1) >= number:
                return None
            now["streams"][stream] = number
        return now | {"batches": now["batches"] + new} if new or stream is not None else None

    return commit(spark, path, change)


def add_missing(spark: SparkSession, path: str, embeddings: DataFrame, q: ivf.Quantiser, domain: str | None = None) -> dict:
    """The vectors that the index lacks; doing it twice adds nothing."""
    todo = written(ivf.missing(read(spark, path), embeddings, q), "missing")
    out = add(spark, path, todo, q, domain) if todo.limit(1).count() else current(spark, path)
    discard(todo)
    return out


def _deleted(spark: SparkSession, path: str, ids: DataFrame, now: dict) -> dict | None:
    """Writes the places of `ids` (passage_id) in the live blocks; what the next version is to say of it, or None where there are none."""
    rows = _posted(spark, path, [b["name"] for b in now["batches"]], now["deletes"])
    at = rows.select("batch", "list_id", F.element_at("passage_ids", 1).alias("first"), "dead", F.posexplode("passage_ids").alias("at", "passage_id"))
    at = at.where(F.col("dead").isNull() | ~F.array_contains("dead", F.col("at")))
    hit = at.join(ids.select(F.col("passage_id").cast("long").alias("passage_id")).distinct(), "passage_id", "left_semi")
    name = uuid.uuid4().hex
    hit.groupBy("batch", "list_id", "first").agg(F.collect_list("at").alias("dead")).write.parquet(f"{path}/deletes/{name}")  # at most a block's entries
    found = [r.batch for r in spark.read.parquet(f"{path}/deletes/{name}").select("batch").distinct().collect()]  # at most the live batches
    return {"name": name, "batches": sorted(found)} if found else None


def _changed(spark: SparkSession, path: str, make: Callable[[dict], tuple[list[dict], list[dict]]], tries: int = 5) -> dict:
    """Commits the batches and deletes that `make` writes from a version; starts again where a batch that they rest on went meanwhile."""
    for left in range(tries - 1, -1, -1):
        batches, deletes = make(current(spark, path))
        needed = {b for d in deletes for b in d["batches"]}

        def change(now: dict) -> dict | None:
            if not needed <= {b["name"] for b in now["batches"]}:
                raise Changed(path)
            return now | {"batches": now["batches"] + batches, "deletes": now["deletes"] + deletes} if batches or deletes else None

        try:
            return commit(spark, path, change)
        except Changed:
            if not left:
                raise


def remove(spark: SparkSession, path: str, ids: DataFrame) -> dict:
    """Takes the vectors of `ids` (passage_id) out; ids that are not there are passed over. Ids of passages are read, codes are not."""
    return _changed(spark, path, lambda now: ([], [d] if (d := _deleted(spark, path, ids, now)) else []))


def put(spark: SparkSession, path: str, embeddings: DataFrame, q: ivf.Quantiser, domain: str | None = None) -> dict:
    """Puts vectors in the place of those with their ids, or adds them; both in one version."""
    new = _write(ivf.encode(embeddings, q, domain), path, uuid.uuid4().hex)
    return _changed(spark, path, lambda now: (new, [d] if (d := _deleted(spark, path, embeddings, now)) else []))


def compact(spark: SparkSession, path: str, q: ivf.Quantiser, fan: int = FAN) -> dict:
    """Merges the oldest `fan` batches of a level into one of the next, as long as a level has so many."""
    while True:
        now = current(spark, path)
        levels = sorted({b["level"] for b in now["batches"]})
        full = [(n, of) for n in levels if len(of := [b["name"] for b in now["batches"] if b["level"] == n]) >= fan]
        if not full:
            return now
        level, of = full[0][0], full[0][1][:fan]
        new = _write(ivf.packed(ivf.entries(_posted(spark, path, of, now["deletes"]), q.code_size), q.code_size), path, uuid.uuid4().hex, level + 1)
        known = [d["name"] for d in now["deletes"]]

        def change(after: dict) -> dict | None:
            live = {b["name"] for b in after["batches"]}
            touched = any(set(d["batches"]) & set(of) for d in after["deletes"] if d["name"] not in known)
            if not set(of) <= live or touched:  # merged by another, or entries were taken out since
                return None
            kept = [b for b in after["batches"] if b["name"] not in of]
            still = {b["name"] for b in kept}
            return after | {"batches": new + kept, "deletes": [d for d in after["deletes"] if set(d["batches"]) & still]}

        commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes old versions but for the newest `keep`, and the folders that none of these names. Not while a change is being written."""
    known = versions(spark, path)
    kept = [current(spark, path, v) for v in known[-keep:]]
    batches, deletes = {b["name"] for n in kept for b in n["batches"]}, {d["name"] for n in kept for d in n["deletes"]}
    for v in known[:-keep]:
        delete(spark, f"{path}/versions/{v:012d}.json")
    for n in names_below(spark, f"{path}/postings"):
        if n.startswith("batch=") and n.removeprefix("batch=") not in batches:
            delete(spark, f"{path}/postings/{n}")
    for n in names_below(spark, f"{path}/deletes"):
        if n not in deletes:
            delete(spark, f"{path}/deletes/{n}")
