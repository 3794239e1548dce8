"""Corpus build: documents, passages, embeddings and index, each stage a table in the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import domain_of, passage_file
from ..operators import ivf
from ..operators.embed import embed
from ..operators.ids import line_positions, running_sums, running_totals
from ..operators.passages import chunk_count, numbered
from ..operators.verify import verify
from ..session import discard
from ..sources.catalog import NOTE, delete, file_catalogue, fingerprint, json_line, missing_files, read_note, stage, text_of, write_note


def complete(needed: DataFrame, present: DataFrame, key: str = "file_id") -> DataFrame:
    """`present`, or an error that names some of the files that it lacks."""
    lost = [str(r[0]) for r in missing_files(needed, present, key).limit(10).collect()]
    if lost:
        raise ValueError(f"missing, by {key}: {', '.join(sorted(lost))}")
    return present


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_name, doc_position (byte offset of the line) and text of each line of the JSON-lines files at `path` that is not blank."""
    return line_positions(spark, path).select("file_name", F.col("position").alias("doc_position"), text_of(F.col("value")).alias("text"))


def passage_positions(passages: DataFrame) -> DataFrame:
    """passage_id and passage_position: where its line begins in its file's JSON-lines file of passages, in the order of passage_id."""
    sizes = passages.select("passage_id", "file_id", (F.octet_length(json_line("passage_id", "text")) + 1).cast("long").alias("size"))
    placed = running_sums(sizes, ["passage_id"], "size", "at")
    first = placed.groupBy("file_id").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "file_id").select("passage_id", (F.col("at") - F.col("first")).alias("passage_position"))  # a row per file


def write_passage_files(passages: DataFrame, path: str) -> None:
    """The passages as JSON lines, one folder per file_id; a file's lines are in order and in one file, as `passage_positions` says."""
    rows = passages.select("file_id", "passage_id", json_line("passage_id", "text").alias("value"))
    rows.repartition("file_id").sortWithinPartitions("file_id", "passage_id").select("file_id", "value").write.partitionBy("file_id").text(path)


def build(texts: DataFrame, store: str, size: int = 128, least_last: int = 64, n_lists: int = 4096, subs: int | None = 16, bits: int = 8, sample_size: int = 10_000_000, rebuild: bool = False, retrain: bool = False, dim: int = 64, encoder=None, encoder_name: str = "hashed", order: list[str] | None = None, fingerprint: str | None = None, turns: int = 0, border: int = 1) -> dict[str, DataFrame]:
    """All tables of a corpus from `texts` (file_name, text and what `order` names, by default the line's doc_position if there is one).

    `passages` are `cuts` joined to their `positions`; who needs no positions takes `cuts`, for which no text is shuffled, and who needs no texts joins what they do need.
    Texts that are null count as empty. Document ids follow the file's name and then `order`. A table that is there is reused if it is whole and
    was made with the same settings, from the same tables, and, where a `fingerprint` is given, from the same input; otherwise it and what
    follows from it is made anew. `rebuild` makes every table anew; `retrain` the quantiser and what follows from it. An index over
    embeddings that lack a file is an error.
    """
    spark = texts.sparkSession
    given = lambda note, **settings: {"from": note["id"], **settings}
    files, of_files = stage(spark, f"{store}/files", lambda: file_catalogue(texts), {"input": fingerprint}, rebuild)
    scratch: list[DataFrame] = []
    named = texts.withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(files), "file_name")  # a row per file name

    def documents() -> DataFrame:
        by = order or (["doc_position"] if "doc_position" in texts.columns else None)
        if by is None:
            raise ValueError("order must name the columns that documents of a file follow")
        scratch.append(running_totals(named, ["file_id", *by], {"doc_id": (None, 0), "passage_start": (chunk_count(F.col("text"), size, least_last), 0)}))
        return scratch[-1]

    docs, of_docs = stage(spark, f"{store}/documents", documents, given(of_files, order=order, size=size, least_last=least_last), rebuild)
    for rows in scratch:
        discard(rows)  # the numbered rows are in `documents` now

    def cut() -> DataFrame:
        rows = numbered(docs.select("doc_id", "file_id", "file_name", F.col("file_name").alias("doc_file"), *(c for c in ["doc_position"] if c in docs.columns), "text", "passage_start"), "passage_start", size, least_last)
        return rows.withColumn("passage_file", passage_file(F.col("file_name")))

    cuts, of_cuts = stage(spark, f"{store}/passages", cut, given(of_docs, size=size, least_last=least_last), rebuild)
    positions, _ = stage(spark, f"{store}/passage_positions", lambda: passage_positions(cuts), given(of_cuts), rebuild)
    passages = cuts.join(positions, "passage_id")
    vectors, of_vectors = stage(spark, f"{store}/embeddings", lambda: embed(cuts.withColumn("domain", domain_of(F.col("file_name"))), encoder=encoder, dim=dim, carry=("file_id", "domain")), given(of_cuts, dim=dim, encoder=encoder_name), rebuild)
    again, path = rebuild or retrain, f"{store}/index"
    wanted = given(of_vectors, n_lists=n_lists, subs=subs or 0, bits=bits, sample_size=sample_size, turns=turns, border=border)
    of_index = None if again else read_note(spark, f"{path}/{NOTE}")
    if of_index is None or of_index["given"] != wanted:
        rows = ivf.sample(complete(cuts, vectors), sample_size)
        delete(spark, path)
        ivf.save(ivf.train(rows, n_lists, subs, bits, turns=turns, border=border), spark, path, encoder_name)
        of_index = {"given": wanted, "id": uuid.uuid4().hex}
        write_note(spark, f"{path}/{NOTE}", of_index)
    q = ivf.load(spark, path, encoder_name)
    made = read_note(spark, f"{store}/postings/{NOTE}")
    if made is None or made["given"] != given(of_index) or ivf.read_postings(spark, f"{store}/postings").count() != made["rows"]:
        delete(spark, f"{store}/postings")
        ivf.write_postings(ivf.encode(vectors, q, "domain"), f"{store}/postings")
        write_note(spark, f"{store}/postings/{NOTE}", {"given": given(of_index), "rows": ivf.read_postings(spark, f"{store}/postings").count()})
    postings = ivf.read_postings(spark, f"{store}/postings")
    return {"files": files, "documents": docs, "cuts": cuts, "positions": positions, "passages": passages, "embeddings": vectors, "postings": postings, "quantiser": q, "report": verify(docs, cuts, vectors, postings, border)}


def build_files(spark: SparkSession, path: str, store: str, **how) -> dict[str, DataFrame]:
    """`build` of the JSON-lines files at `path`: scan, line positions, ids by (file, line), passages, embeddings and index. Changed files are seen."""
    return build(read_lines(spark, path), store, **{"fingerprint": fingerprint(spark, path)} | how)
