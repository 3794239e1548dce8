"""Index maintenance as a stream: new files of embeddings are encoded once and appended; new files of texts become documents, passages and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.arrow_text import chunk_count
from ..functions.text import domain_of, passage_file
from ..operators import ivf, living
from ..operators.embed import embed
from ..operators.ids import line_columns, positioned
from ..operators.passages import numbered
from ..session import discard
from ..sources.catalog import delete, names_below, read_note, text_of, write_note


def maintain(spark: SparkSession, embeddings: str, schema: StructType | str, q: ivf.Quantiser, postings: str, checkpoint: str, domain: str | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Appends the postings of files that have not been seen; the checkpoint remembers them.

    Each batch has a folder of its own, by its number, so that a batch that is repeated after a failure replaces itself. Nothing that was
    indexed before is read, and the cost of a batch is that of its files. With frozen centroids and codebooks the result equals
    one build over all files.
    """

    def add(batch: DataFrame, number: int) -> None:
        ivf.write_postings(ivf.encode(batch, q, domain=domain), postings, f"stream-{number}")

    return _run(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(embeddings), add, checkpoint)


def maintain_store(spark: SparkSession, embeddings: str, schema: StructType | str, q: ivf.Quantiser, store: str, checkpoint: str, domain: str | None = None, files_per_batch: int = 1000, fan: int = living.FAN) -> StreamingQuery:
    """The same into a store of `operators.living`: readers see whole batches, and small batches are merged as they come."""

    def add(batch: DataFrame, number: int) -> None:
        living.add(spark, store, batch, q, domain, "embeddings", number)
        living.compact(spark, store, q, fan)

    return _run(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(embeddings), add, checkpoint)


def _run(rows: DataFrame, add, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# From new files to the index

_NUMBERS = ("files", "documents", "passages")


def take_up(lines: DataFrame, number: int, store: str, q: ivf.Quantiser, size: int = 128, least_last: int = 64, encoder=None, dim: int = 64, fan: int = living.FAN) -> None:
    """Batch `number` of a stream of `lines` (file_path, split, value): scan, line positions, ids, passages, embeddings and index entries.

    Ids go on where the batch before ended: its note says where, and a batch's own note is written when all its tables are. A batch that is
    repeated gets the same ids and replaces its own tables; one whose note is there is passed over, and is an error if it has other files.
    """
    spark = lines.sparkSession
    note = read_note(spark, f"{store}/batches/{number}.json")
    files = sorted(r.file_path for r in lines.select("file_path").distinct().collect())  # at most the files of a batch
    if note is not None:
        if note["read"] != files:
            raise ValueError(f"batch {number} was of other files")
        return
    first = dict.fromkeys(_NUMBERS, 0)
    if number:
        before = read_note(spark, f"{store}/batches/{number - 1}.json")
        if before is None:
            raise ValueError(f"batch {number - 1} is not done")
        first = before["next"]

    def table(name: str, rows: DataFrame) -> DataFrame:
        path = f"{store}/{name}/batch={number}"
        delete(spark, path)
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    placed = positioned(lines, text_of(F.col("value")), n=lambda texts: chunk_count(texts, size, least_last))  # a line is parsed once
    counts = placed.groupBy("file_name").agg(F.count("*").alias("documents"), F.sum("n").alias("passages"))  # a row per file
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first[c]
    known = table("files", counts.select("file_name", before("documents").alias("first_doc"), before("passages").alias("first_passage"), (F.row_number().over(Window.orderBy("file_name")) - 1 + first["files"]).cast("long").alias("file_id")))
    texts = placed.join(F.broadcast(known), "file_name")  # a row per file of a batch
    rows = texts.select("file_name", "file_id", F.col("position").alias("doc_position"), "text", (F.col("first_doc") + F.col("number")).alias("doc_id"), (F.col("first_passage") + F.col("n_before")).alias("passage_start"))
    docs = table("documents", rows)
    discard(placed.select("text"))
    cut = numbered(docs.select("doc_id", "file_id", "file_name", F.col("file_name").alias("doc_file"), "doc_position", "text", "passage_start"), "passage_start", size, least_last)
    cuts = table("passages", cut.withColumn("passage_file", passage_file(F.col("file_name"))))
    vectors = table("embeddings", embed(cuts.withColumn("domain", domain_of(F.col("file_name"))), encoder=encoder, dim=dim, carry=("file_id", "domain")))
    living.add(spark, f"{store}/index", vectors, q, "domain", "files", number)
    living.compact(spark, f"{store}/index", q, fan)
    ends = {n: first[n] + t.count() for n, t in zip(_NUMBERS, (known, docs, cuts))}
    write_note(spark, f"{store}/batches/{number}.json", {"read": files, "first": first, "next": ends})


def grow(spark: SparkSession, path: str, store: str, q: ivf.Quantiser, checkpoint: str, files_per_batch: int = 1000, **how) -> StreamingQuery:
    """Takes up the JSON-lines files at `path` that have not been seen; `how` goes to `take_up`. What comes of it equals one build, but for the order of files."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("lineSep", "\n").text(path).select(*line_columns())
    return _run(rows, lambda batch, number: take_up(batch, number, store, q, **how), checkpoint)


def grown(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """files, documents, passages, embeddings and postings of the batches that are done."""
    done = sorted(int(n.removesuffix(".json")) for n in names_below(spark, f"{store}/batches") if n.endswith(".json") and not n.startswith("."))
    if not done:
        raise ValueError(f"nothing has been taken up in {store}")
    tables = {n: spark.read.option("basePath", f"{store}/{n}").parquet(*(f"{store}/{n}/batch={b}" for b in done)).drop("batch") for n in ("files", "documents", "passages", "embeddings")}
    return tables | {"postings": living.read(spark, f"{store}/index")}
