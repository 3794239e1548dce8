"""Files in and out: corpora as Parquet or JSON lines, the catalogue of files, and stores of passages and vectors."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slot


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every Parquet file exactly one folder below `root`, with its folder and file name."""
    rows = spark.read.parquet(f"{root}/*/*.parquet")
    path = F.col("_metadata.file_path")
    return rows.select("*", F.element_at(F.split(path, "/"), -2).alias("folder"), F.col("_metadata.file_name").alias("part"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name and text of each JSON line that is not blank; a missing, null or non-string text is empty."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return lines.where(F.col("value").rlike("\\S")).select("file_name", text_of(F.col("value")).alias("text"))


def text_of(line: Column) -> Column:
    return F.coalesce(F.get_json_object(line, "$.text"), F.lit(""))


def write_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines that keep nulls as null."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def conversion_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, rows and ok of each file; a file that cannot be read is a row with ok false and does not stop the others."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    read = spark.read.option("ignoreCorruptFiles", "true").schema("_none int").parquet(*paths)  # rows are counted, no column is read
    counts = read.groupBy(F.col("_metadata.file_path").alias("found")).agg(F.count("*").alias("rows"))
    same = F.regexp_replace("found", "^file:/+", "/") == F.regexp_replace("path", "^file:/+", "/")
    return listed.join(counts, same, "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("found").isNotNull().alias("ok"))


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The data files in the folder `path`, by listing it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(f.getPath().toString() for f in found if not f.getPath().getName().startswith(("_", ".")))


def file_catalogue(rows: DataFrame, file: str = "file_name") -> DataFrame:
    """file_id (from 0 in name order) and file_name. Names are few beside rows, so one task numbers them."""
    from pyspark.sql import Window

    names = rows.select(F.col(file).alias("file_name")).distinct()
    return names.withColumn("file_id", F.row_number().over(Window.orderBy("file_name")) - 1)


def strided(file_id: Column, n: int) -> Column:
    return F.pmod(file_id, F.lit(n))


def contiguous(files: DataFrame, n: int, order: str = "file_id") -> DataFrame:
    """Adds shard: n runs of files, the first ones taking what does not divide."""
    from pyspark.sql import Window

    return files.withColumn("shard", F.ntile(n).over(Window.orderBy(order)) - 1)


def not_done(rows: DataFrame, done: DataFrame, key: str = "file_id", overwrite: bool = False) -> DataFrame:
    """Rows whose key is not in `done` yet, or all with `overwrite`."""
    return rows if overwrite else rows.join(done.select(key).distinct(), key, "left_anti")


def write_store(rows: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """Parquet, one folder per value of `by`; mode "overwrite" then replaces just the folders that `rows` has."""
    out = rows.write.mode(mode)
    if by:
        out = out.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def missing_files(needed: DataFrame, present: DataFrame, key: str = "file_id") -> DataFrame:
    """Keys of `needed` that `present` lacks, which whoever needs completeness tests for emptiness."""
    return needed.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the store that holds the path, through Spark's own file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def read_note(spark: SparkSession, path: str) -> dict | None:
    """The small JSON file at `path`, or None where there is none."""
    hadoop, fs = _at(spark, path)
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, note: dict) -> bool:
    """Writes a small JSON file that is there whole or not at all; False, and nothing done, where there is one already."""
    hadoop, fs = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(note).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(hadoop).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(part, fs.makeQualified(hadoop), none)  # fails where the name is taken
        return True
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    hadoop, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the files at `path` (a file, or a folder and the folders in it): changes when one is added, removed, written anew or of another size."""
    hadoop, fs = _at(spark, path)
    todo, seen, n, size = [fs.getFileStatus(hadoop)], 0, 0, 0
    while todo:
        f = todo.pop()
        if f.isDirectory():
            todo += list(fs.listStatus(f.getPath()))
        elif not f.getPath().getName().startswith(("_", ".")):
            one = uuid.uuid5(uuid.NAMESPACE_URL, f"{f.getPath().getName()}|{f.getLen()}|{f.getModificationTime()}").int
            seen, n, size = seen ^ one, n + 1, size + f.getLen()
    return f"{n} files, {size} bytes, {seen:032x}"


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file; folders on the way are made."""
    source, fs = _at(spark, path)
    target, _ = _at(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"cannot move {path} to {to}")


NOTE = "_stage.json"


def stage(spark: SparkSession, path: str, make, given: dict | None = None, rebuild: bool = False) -> tuple[DataFrame, dict]:
    """The table at `path` and its note: made by `make` and written unless it is whole and came about as `given` says.

    The note lies in the table's folder and is written last, so a table whose writing was cut off has none. It holds `given` (parameters,
    input fingerprint, the ids of tables that this one was made from), the number of rows, and an id of its own. A table with another number of
    rows, as when a file was lost, or other values of `given` is made anew; values of None are not compared.
    """
    given, note = given or {}, read_note(spark, f"{path}/{NOTE}")
    if note and not rebuild and all(v is None or note["given"].get(k) == v for k, v in given.items()):
        try:
            found = spark.read.parquet(path)
            if found.count() == note["rows"]:
                return found, note
        except Exception:  # no file is left, or one cannot be read: it is made anew, and what fails then is an error
            pass
    delete(spark, path)
    make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    note = {"given": given, "rows": found.count(), "id": uuid.uuid4().hex}
    write_note(spark, f"{path}/{NOTE}", note)
    return found, note


def cached(spark: SparkSession, path: str, make, given: dict | None = None) -> DataFrame:
    """The table at `path`, made and written first if it is not there, not whole, or made from other `given` values."""
    return stage(spark, path, make, given)[0]


def pick_queries(requests: DataFrame, questions: DataFrame, n: int, seed: int = 42, key: str = "request_id") -> DataFrame:
    """Gives each request one of `n` questions (query_id from 0, query), with replacement; the same each time."""
    pick = slot(F.col(key).cast("string"), n, seed)
    return requests.withColumn("query_id", pick).join(questions, "query_id")
