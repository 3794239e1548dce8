"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a local session, as in tests, names none, a new temporary folder is set for it; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, in this application's folder; who runs applications may delete that once they have ended."""
    return f"{shared_dir(spark)}/lodestack/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a table in the shared folder, with options of the Parquet writer: ids and samples are fixed from here on, and lineage ends."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that `written` gave and that nothing will read again, such as the state of a round that is over."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if f"/lodestack/{spark.sparkContext.applicationId}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
