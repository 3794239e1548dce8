"""Corpus statistics and summaries of latency logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written

#: Rows of a log up to which Spark's own exact percentiles are taken, which hold a group's distinct values in a task.
HELD = 1_000_000
_DIGIT = 16


def _bits(rows: DataFrame) -> DataFrame:
    """_g and _u: the value's 64 bits in an order that is that of the values; not-a-number is the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).to_numpy(zero_copy_only=False) + 0.0  # one zero
            bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)) ^ np.int64(-(1 << 63)))], ["_g", "_u"])

    return rows.mapInArrow(run, f"_g {rows.schema['_g'].dataType.simpleString()}, _u long")


def _values(rows: DataFrame, kind: str) -> DataFrame:
    """The values whose bits stand in _prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False) ^ np.int64(-(1 << 63))
            bits = u ^ ((u >> 63) & np.int64((1 << 63) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bits.view(np.float64))], [*b.schema.names[:-1], "x"])

    return rows.mapInArrow(run, f"_g {kind}, _q double, _part double, _upper boolean, x double")


def quantiles(rows: DataFrame, qs: Sequence[float], *by: str, value: str = "latency") -> DataFrame:
    """The columns `by`, q and value: exact quantiles of each group, between neighbours in proportion. Nulls do not count.

    No group is held together. A value's 64 bits are put in an order that is that of the values, and found sixteen at a time: each of four
    rounds counts the next sixteen bits of the values that begin as a wanted one does, which is combined within tasks, and takes the
    bits where the counts reach its rank. A round shuffles at most 65,536 counts for each wanted beginning and task.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    picked = rows.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_x"))
    kind = picked.schema["_g"].dataType.simpleString()
    bits = written(_bits(picked), "bits")
    sizes = bits.groupBy("_g").agg(F.count("*").alias("_n")).select("_g", "_n", F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("_q"))
    at = F.col("_q") * (F.col("_n") - 1)
    sizes = sizes.select("_g", "_q", (at - F.floor(at)).alias("_part"), F.explode(F.array(F.struct(F.lit(False).alias("upper"), F.floor(at).alias("rank")), F.struct(F.lit(True).alias("upper"), F.ceil(at).alias("rank")))).alias("_t"))
    state = written(sizes.select("_g", "_q", "_part", F.col("_t.upper").alias("_upper"), F.col("_t.rank").alias("_rank"), F.lit(0).cast("long").alias("_prefix")), "ranks")
    for r in range(64 // _DIGIT):
        seen = bits.withColumn("_prefix", F.shiftrightunsigned("_u", 64 - _DIGIT * r) if r else F.lit(0).cast("long"))
        if r:
            seen = seen.join(state.select("_g", "_prefix").distinct(), ["_g", "_prefix"])
        digit = F.shiftrightunsigned("_u", 64 - _DIGIT * (r + 1)).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        counts = seen.groupBy("_g", "_prefix", digit.alias("_digit")).agg(F.count("*").alias("_c"))
        upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_g", "_prefix").orderBy("_digit")))
        hit = state.join(upto, ["_g", "_prefix"]).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        last, state = state, written(hit.select("_g", "_q", "_part", "_upper", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), F.shiftleft("_prefix", _DIGIT).bitwiseOR(F.col("_digit")).alias("_prefix")), "ranks")
        discard(last)
    found = _values(state.select("_g", "_q", "_part", "_upper", "_prefix"), kind).groupBy("_g", "_q", "_part").agg(F.max(F.when(~F.col("_upper"), F.col("x"))).alias("a"), F.max(F.when(F.col("_upper"), F.col("x"))).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("_part"))
    return found.select(*(F.col(f"_g.`{c}`").alias(c) for c in by), F.col("_q").alias("q"), between.alias("value"))


def _with_quantiles(log: DataFrame, found: DataFrame, qs: dict[str, float], by: Sequence[str], latency: str) -> DataFrame:
    """`found` (a row for each group) with a column for each quantile."""
    got = quantiles(log, list(qs.values()), *by, value=latency)
    wide = got.groupBy(*by).agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in qs.items()))
    if not by:
        return found.crossJoin(wide)  # one row each
    same = [found[c].eqNullSafe(wide[c]) for c in by]
    return found.join(wide, same, "left").select(*(found[c] for c in found.columns), *qs)


def corpus_stats(passages: DataFrame, docs: DataFrame, file: str = "file_id") -> DataFrame:
    """One row: passages, documents, and the files of each."""
    p = passages.agg(F.count("*").alias("total_passages"), F.countDistinct(file).alias("num_passage_files"))
    d = docs.agg(F.count("*").alias("total_documents"), F.countDistinct(file).alias("num_document_files"))
    return p.crossJoin(d)  # one row each


def latency_metrics(log: DataFrame, *by: str, latency: str = "latency", success: str = "success", held: int = HELD) -> DataFrame:
    """Counts, success rate, throughputs and the distribution of latencies of each group; zeros for an empty log.

    All requests' latencies count, failed ones too; ok_mean has the successful ones alone. throughput_serial is requests
    by the sum of latencies. The percentiles of a log of more than `held` rows are found by `quantiles`.
    """
    x = F.col(latency).cast("double")
    value = lambda c: F.coalesce(c, F.lit(0.0))
    n, ok = F.count("*"), F.count(F.when(F.col(success), 1))
    many, qs = log.limit(held + 1).count() > held, {"median": 0.5, "p95": 0.95, "p99": 0.99}
    middle = {c: F.lit(None).cast("double") if many else F.expr(f"percentile({latency}, {q})").cast("double") for c, q in qs.items()}
    aggs = [
        n.alias("total_requests"), ok.alias("successful_requests"), (n - ok).alias("failed_requests"),
        value(F.when(n > 0, 100.0 * ok / n)).alias("success_rate"), value(F.sum(x)).alias("total_time"), value(F.when(F.sum(x) > 0, n / F.sum(x))).alias("throughput_serial"),
        value(F.min(x)).alias("min"), value(F.max(x)).alias("max"), value(F.avg(x)).alias("mean"), *(value(c).alias(name) for name, c in middle.items()),
        value(F.stddev_pop(x)).alias("std"), value(F.avg(F.when(F.col(success), x))).alias("ok_mean"),
    ]
    out = log.groupBy(*by).agg(*aggs) if by else log.agg(*aggs)
    if not many:
        return out
    order = out.columns
    return _with_quantiles(log, out.drop(*qs), qs, by, latency).select(*(value(F.col(c)).alias(c) if c in qs else F.col(c) for c in order))


def wall_throughput(log: DataFrame, *by: str, start: str = "ts", latency: str = "latency") -> DataFrame:
    """Requests by the time from the first start to the last end."""
    begin = F.unix_micros(F.col(start).cast("timestamp")) / 1e6
    wall = F.max(begin + F.col(latency)) - F.min(begin)
    return log.groupBy(*by).agg(F.count("*").alias("total_requests"), F.when(wall > 0, F.count("*") / wall).otherwise(0.0).alias("throughput_wall"))


def warmup_summary(log: DataFrame, *by: str) -> DataFrame:
    return latency_metrics(log, *by).select(*by, "success_rate", "mean")


def histogram(log: DataFrame, by: str, value: str = "latency", bins: int = 50, held: int = HELD) -> DataFrame:
    """Equal-width bins from each group's least to its largest value; the last bin has its top edge. Empty bins have no row."""
    x = F.col(value).cast("double")
    ends = log.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.expr(f"percentile({value}, 0.5)").cast("double").alias("median"))
    if log.limit(held + 1).count() > held:
        ends = _with_quantiles(log, log.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean")), {"median": 0.5}, [by], value)
    inside = F.floor((x - F.col("low")) / (F.col("high") - F.col("low")) * bins) + 1
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins), inside)).otherwise(F.lit(1)).cast("int")
    rows = log.where(x.isNotNull()).join(ends, by).withColumn("bin", at)
    return rows.groupBy(by, "bin").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.first("median").alias("median"))


def phase_timings(log: DataFrame) -> DataFrame:
    """avg, min and max seconds of each query's phases over its runs."""
    return log.groupBy("query_id", "phase").agg(F.avg("seconds").alias("avg"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))


def overall_timings(log: DataFrame) -> DataFrame:
    """Per phase, avg, min and max of the per-query averages, and the share of the phase called total (null without one)."""
    phases = phase_timings(log).groupBy("phase").agg(F.avg("avg").alias("avg"), F.min("avg").alias("min"), F.max("avg").alias("max"))
    total = phases.where("phase = 'total'").select(F.col("avg").alias("whole"))
    return phases.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("whole") > 0, 100 * F.col("avg") / F.col("whole"))).drop("whole")  # one row
