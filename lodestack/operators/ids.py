"""Dense ids and running sums without a global sort in one task, and line positions in split files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def running_totals(rows: DataFrame, order: list[str], sums: dict[str, tuple[Column | str | None, int]]) -> DataFrame:
    """`rows` with a column for each of `sums`, (amount, start) by name: start and the sum of amount (a long; None: 1) over all rows before.

    An amount that is an expression is worked out where a row has been dealt to. The order of `order` should be unique, or ties fall as they lie. Rows are dealt by ranges, sorted and added up within tasks and written
    once; one sum per task goes to the driver. Give it keys and amounts alone where the rest of a row is large.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, k = list(sums), len(sums)
    amounts = {f"_n{i}": (F.lit(1) if c is None else F.col(c) if isinstance(c, str) else c).cast("long") for i, (c, _) in enumerate(sums.values())}
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns(amounts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), [0] * k
        for b in batches:
            local, own = [], []
            for i in range(k):
                n = b.column(b.num_columns - k + i).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(n)
                local.append(pa.array(done[i] + ends - n))
                own.append(pa.array(n))
                done[i] += int(ends[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-k], pa.array(np.full(b.num_rows, part, np.int32)), *local, *own], [*b.schema.names[:-k], "_part", *(f"_l{i}" for i in range(k)), *(f"_n{i}" for i in range(k))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kinds += ", _part int" + "".join(f", _l{i} long" for i in range(k)) + "".join(f", _n{i} long" for i in range(k))
    placed = written(dealt.mapInArrow(run, kinds), "placed")
    found = sorted(tuple(r) for r in placed.groupBy("_part").agg(*(F.sum(f"_n{i}").alias(f"n{i}") for i in range(k))).collect())
    at, before = [start for _, start in sums.values()], []
    for _, *n in found:
        before.append(at)
        at = [a + x for a, x in zip(at, n)]
    columns = {"_of": pa.array([r[0] for r in found], pa.int32())} | {f"_b{i}": pa.array([b[i] for b in before], pa.int64()) for i in range(k)}
    offsets = spark.createDataFrame(pa.table(columns), "_of int" + "".join(f", _b{i} long" for i in range(k)))
    joined = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))  # a row per task
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns if c not in names), *((F.col(f"_b{i}") + F.col(f"_l{i}")).alias(n) for i, n in enumerate(names)))


def running_sums(rows: DataFrame, order: list[str], amount: str | None = None, name: str = "start", start: int = 0) -> DataFrame:
    """`running_totals` of one amount (1 without one)."""
    return running_totals(rows, order, {name: (amount, start)})


def dense_ids(rows: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """`rows` with ids from `start`, without gaps, in the order of `order`."""
    return running_sums(rows, order, None, name, start)


def starts(counts: DataFrame, order: str = "file_id", count: str = "n", name: str = "start") -> DataFrame:
    """Exclusive running sum over a small table of counts (one row per file or task)."""
    from pyspark.sql import Window

    return counts.withColumn(name, F.coalesce(F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def line_positions(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_path, position (byte offset) and value of each line that is not blank; blank lines count for offsets alone."""
    return positioned(spark.read.option("lineSep", "\n").text(path).select(*line_columns())).drop("number")


def line_columns() -> list[Column]:
    """Of lines as they are read, or streamed: the file, the split and the line."""
    return [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split"), F.col("value")]


def positioned(lines: DataFrame, text: Column | None = None, **amounts: Column | Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """`line_positions` of lines that come with their file_path and split, and number: of each line among the file's lines that are not blank, from 0.

    With `text`, worked out from a line's value, rows have that in the value's place. Of each of `amounts` (a long, by the line's value, or what
    maps a batch of values, or of texts, to whole numbers) there is the amount, and under the name with "_before" its sum over the file's earlier lines that are
    not blank. A file's splits are summed apart: all is added up within a split as it is read, and each split's sums go to the later
    ones, so no line is shuffled.
    """
    from pyspark.sql import Window

    kept = "value" if text is None else "text"
    names = ["size", "number", *(f"{c}_before" for c in amounts)]
    size, real = (F.octet_length("value") + 1).cast("long"), F.col("value").rlike("\\S")
    rows = lines.select("file_path", "split", (F.col("value") if text is None else text).alias(kept), size.alias("_size"), real.alias("_real"), *(c.cast("long").alias(n) for n, c in amounts.items() if isinstance(c, Column)))
    of_batch = [(lambda b, n=n: pc.fill_null(b.column(n), 0).to_numpy(zero_copy_only=False)) if isinstance(c, Column) else (lambda b, c=c: c(b.column(kept))) for n, c in amounts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a split come in order and a split is read by one task, one after another."""
        at, done = None, np.zeros(len(names), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            real = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            own = [b.column(3).to_numpy(zero_copy_only=False), real.astype(np.int64), *(np.where(real, amount(b), 0).astype(np.int64) for amount in of_batch)]
            paths, splits = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((paths[1:] != paths[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), b.num_rows]
            local = np.empty((len(names), b.num_rows), np.int64)
            for i, j in zip(cuts[:-1], cuts[1:]):
                if (paths[i], splits[i]) != at:
                    at, done = (paths[i], splits[i]), np.zeros(len(names), np.int64)
                ends = np.cumsum(np.stack([x[i:j] for x in own]), axis=1)
                local[:, i:j] = done[:, None] + ends - np.stack([x[i:j] for x in own])
                done = done + ends[:, -1]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x) for x in local), *(pa.array(x) for x in own)], [*b.schema.names[:3], *(f"_l{k}" for k in range(len(names))), *(f"_n{k}" for k in range(len(names)))])

    kinds = ", ".join(f"{c} long" for c in (*(f"_l{k}" for k in range(len(names))), *(f"_n{k}" for k in range(len(names)))))
    placed = written(rows.mapInArrow(run, f"file_path string, split long, {kept} string, {kinds}"), "lines", compression="zstd")  # whole lines
    earlier = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("file_path", "split").agg(*(F.sum(f"_n{k}").alias(f"_s{k}") for k in range(len(names))))
    sums = sums.select("file_path", "split", *(F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in range(len(names))))
    found = placed.where(F.col("_n1") == 1).join(F.broadcast(sums), ["file_path", "split"])  # a row per split: else lines are shuffled to meet theirs
    of = lambda k: F.col(f"_b{k}") + F.col(f"_l{k}")
    return found.select(F.substring_index("file_path", "/", -1).alias("file_name"), "file_path", of(0).alias("position"), kept, of(1).alias("number"), *(F.col(f"_n{k}").alias(c) for k, c in enumerate(amounts, 2)), *(of(k).alias(names[k]) for k in range(2, len(names))))
