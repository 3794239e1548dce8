"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and `most` copies. Among all rates whose tokens meet each source's target, entropy
balancing takes those of least relative entropy to the corpus as it is, one copy each. The dual is convex in one
multiplier b per source, and its solution is an exponential tilt of the documents,

    rate = min(most, exp(b * size / mean size)),

so that a source that must shrink gives up its long documents first, and one that must grow repeats them first. The
dual's gradient and curvature are sums over documents: each round of Newton's iteration is one aggregation for all
sources at once, over the written histogram of (source, size), which has far fewer rows than there are documents; one
row per source reaches the driver. A step that leaves the interval known to hold the solution is replaced by its middle.

Rates become whole copies by a threshold on hashed priorities, found for each source by three rounds of histograms. A
document too long for what is lacking is passed over for shorter ones, so that the copies' tokens meet the target to within
about one common document. A second run gives the same copies.

Defined cases: a null text has size 0 and rate 1; null is a source of its own, last; a source without words has target 0;
rows that repeat a doc_id within a source get equal copies; an empty table gives an empty result; other
columns are kept by `mixed` under any name. The driver holds a few numbers per source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, words, written

WEIGHTS = (3.0, 1.0, 2.0)
SEED, BINS, ROUNDS = 42, 1024, 3


def capped_shares(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is above goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        by = left / sum(weights[i] for i in free)
        full = [i for i in free if by * weights[i] > most * sizes[i]]
        for i in full or free:
            out[i] = most * float(sizes[i]) if full else by * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def _rate(most: float) -> Column:
    """exp(b * size / mean), at most `most`; the exponent is cut where it has no effect, so that it cannot overflow."""
    tilt = F.exp(F.least(F.col("b") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(float(most)), tilt))


def _uniform(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)


def _again() -> Column:
    return _uniform(SEED + 1)


def _priority() -> Column:
    """From 0 to 1, for documents whose rate has a fraction: less than about a half for an extra copy.

    It grows with a hashed uniform number u over that fraction; u / (u + fraction) has an end, so that it can be searched by bins.
    """
    u, part = _uniform(SEED), F.col("rate") - F.floor("rate")
    return F.when(part > 0, u / (u + part))


_PLAN = T.StructType().add("plan_source", "string").add("source_size", "long").add("n_docs", "long")
for _name in ("target", "mean", "b"):
    _PLAN.add(_name, "double")
_PLAN.add("full", "boolean")
for _name in ("low", "low2", "low3", "room", "room2", "width", "need"):
    _PLAN.add(_name, "double")
_PLAN_ARROW = to_arrow_schema(_PLAN)


def _table(spark, plan: dict) -> DataFrame:
    """As a local relation, whose size Spark knows when it picks a join."""
    rows = pa.Table.from_pylist([{f.name: p[f.name] for f in _PLAN} for p in plan.values()], _PLAN_ARROW)
    return spark.createDataFrame(rows, _PLAN)


def _with(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan, rows.source.eqNullSafe(plan.plan_source)).drop("plan_source")


def _newton(hist: DataFrame, plan: dict, most: float, tolerance: float = 1e-9, rounds: int = 60) -> None:
    """Sets b of every source that is not to be taken in full.

    With x = size / mean, the tokens taken, in means, are g(b) = sum of x * min(most, exp(b * x)), which grows with b. g(0) is the
    source's size. Below it, x * exp(b * x) <= 1 / (e * -b) bounds b from below; above it, b is at most the one that
    brings the least document to `most`.
    """
    spark = hist.sparkSession
    for p in plan.values():
        p["need"], n = p["target"] / p["mean"], p["n_docs"]
        p["done"] = p["full"] or p["source_size"] == 0
        p["low"], p["high"] = (-n / (math.e * p["need"]), 0.0) if p["target"] < p["source_size"] else (0.0, math.log(most) * p["mean"])
    for _ in range(rounds):
        left = {s: p for s, p in plan.items() if not p["done"]}
        if not left:
            return
        x, n, r = F.col("size") / F.col("mean"), F.col("n"), F.col("r")
        rated = _with(hist, _table(spark, left)).withColumn("r", _rate(most))
        sums = rated.groupBy("source").agg(F.sum(n * r * x).alias("g"), F.sum(F.when(r < most, n * r * x * x).otherwise(0.0)).alias("slope"))
        for s in sums.collect():
            p = plan[s.source]
            over = s.g - p["need"]
            p["done"] = abs(over) <= tolerance * p["need"]
            if p["done"]:
                continue
            p["low" if over < 0 else "high"] = p["b"]
            step = p["b"] - over / s.slope if s.slope > 0 else math.inf
            p["b"] = step if p["low"] < step < p["high"] else (p["low"] + p["high"]) / 2


def _narrowed(rows: DataFrame, plan: dict, nearest: bool) -> None:
    """Moves each source's low up to where the sizes of its `rows` (source, size, q) with q below it come to need, by BINS a round.

    Sums stay at need or under, but with `nearest` the last step goes over where that is nearer. need becomes what is still lacking.
    """
    spark = rows.sparkSession
    for k in range(ROUNDS):
        inside = _with(rows, _table(spark, plan)).where("q >= low and width > 0").withColumn("bin", F.floor((F.col("q") - F.col("low")) / F.col("width"))).where(F.col("bin") < BINS)
        bins = inside.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("need").alias("need"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin")))
        over = F.when(F.col("upto") > F.col("need"), F.struct("bin", "n"))
        ends = upto.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).alias("upto"), F.min(over).alias("crossed"))
        found = {r.source: r for r in ends.collect()}
        for s, p in plan.items():
            r = found.get(s)
            p["need"] -= float(r.upto or 0) if r else 0.0
            if not r or r.crossed is None:  # all of them are wanted, up to the end of the interval
                p["low"], p["width"] = p["low"] + BINS * p["width"], 0.0
                continue
            p["low"] += r.crossed.bin * p["width"]
            if nearest and k == ROUNDS - 1 and r.crossed.n - p["need"] < p["need"]:
                p["low"] += p["width"]
                p["need"] -= r.crossed.n
            p["width"] /= BINS


def _thresholds(sizes: DataFrame, plan: dict, most: float) -> None:
    """The priorities under which a source's documents get one copy more than their rate's whole part.

    Up to `low` all do; a very long document may end this well before the target. From there up to `low2`, those do that have no more
    words than were then lacking (`room`). Where over a hundredth is still lacking since such a document was passed over, others get
    one more copy, in another hashed order, up to `low3`.
    """
    spark = sizes.sparkSession
    rows = _with(sizes, _table(spark, plan)).withColumn("rate", _rate(most)).withColumn("q", _priority())
    sure = {r.source: r.sure for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.floor("rate")).alias("sure")).collect()}
    for s, p in plan.items():
        p["low"], p["width"], p["need"] = 0.0, 1.0 / BINS, p["target"] - float(sure.get(s) or 0)
    rows = rows.where("q is not null").select("source", "size", "q")
    _narrowed(rows, plan, nearest=False)
    first = {s: (p["low"], p["need"]) for s, p in plan.items()}
    for p in plan.values():
        p["room"], p["width"] = p["need"], (1.0 - p["low"]) / BINS
    _narrowed(_with(rows, _table(spark, plan).select("plan_source", "room")).where(F.col("size") <= F.col("room")).drop("room"), plan, nearest=True)
    for s, p in plan.items():
        p["low2"], p["room2"] = p["low"], p["need"]
        p["low"], p["room"] = first[s]
    lacking = {s: p | {"need": p["room2"], "low": 0.0, "width": 1.0 / BINS} for s, p in plan.items() if p["room2"] > 0.01 * p["target"]}
    if lacking:  # a source of which one document is a large part
        more = applied(sizes, _table(spark, plan), most).where((F.col("copies") + 1 <= most) & (F.col("size") <= F.col("room2"))).select("source", "size", _again().alias("q"))
        _narrowed(more, lacking, nearest=True)
        for s, p in lacking.items():
            plan[s]["low3"] = p["low"]


def planned(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """One row per source of `docs` (doc_id, source, text): sizes, target, tilt and threshold; and doc_id, source and size of every row."""
    sizes = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    hist = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    found = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = capped_shares([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))], share * sum(r.size for r in found), most)
    plan = {}
    for r, t in zip(found, targets):
        plan[r.source] = {"plan_source": r.source, "source_size": r.size, "n_docs": r.n, "target": t, "mean": max(r.size / r.n, 1e-9), "b": 0.0, "full": t >= most * r.size, "done": False} | dict.fromkeys(("low", "low2", "low3", "room", "room2", "width", "need"), 0.0)
    _newton(hist, plan, most)
    discard(hist)
    _thresholds(sizes, plan, most)
    return _table(docs.sparkSession, plan), sizes


def applied(docs: DataFrame, plan: DataFrame, most: float = 2.0) -> DataFrame:
    """doc_id, source and size of `docs`, with source_size, target, rate and copies. No shuffle: the plan has a row per source."""
    rows = _with(docs, plan).withColumn("rate", _rate(most)).withColumn("q", _priority())
    extra = F.coalesce((F.col("q") < F.col("low")) | (F.col("size") <= F.col("room")) & (F.col("q") < F.col("low2")), F.lit(False))
    copies = (F.floor("rate") + extra.cast("long")).cast("long")
    again = (copies + 1 <= most) & (F.col("size") <= F.col("room2")) & (_again() < F.col("low3"))
    return rows.withColumn("copies", copies + F.coalesce(again, F.lit(False)).cast("long"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    plan, _ = planned(docs.select("doc_id", "source", "text"), **how)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    taken = applied(rows, plan, how.get("most", 2.0)).where("copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")


def op9_mixing(spark, sf_dir):
    from .common import documents

    plan, sizes = planned(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return applied(sizes, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
