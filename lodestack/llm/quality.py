"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every measure is a Catalyst expression over the row, so the rules run inside the scan's stage: no shuffle,
no user function, and a lost task is just read again.

Defined cases: a null text counts as empty (no words, base_failed); ratios over nothing are 0; rows repeat as
they come; a null doc_id is carried through; columns beside `doc_id` and `text` are ignored by the measures and
kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words


class Rule(NamedTuple):
    name: str
    measure: str
    low: float | None
    high: float | None


#: Common function words of the languages served, lower case.
STOP_WORDS = (
    "the of and to in is that it for was with are by on this be from at as or an a "
    "le la les de des du et un une en dans que qui est pour sur pas par au avec il elle "
    "der die das und den von mit zu ist im dem ein eine auf sich nicht als für "
    "el los las y del una con por para se no su lo al como"
).split()

#: A document is kept if each measure lies between low and high.
RULES = (
    Rule("enough words", "n_words", 50, None),
    Rule("few repeated phrases", "repeat_ratio", None, 0.5),
    Rule("few symbols", "symbol_ratio", None, 0.1),
    Rule("plausible word length", "mean_word_chars", 2, 20),
    Rule("some function words", "stop_ratio", 0.01, None),
    Rule("few repeated lines", "dup_line_ratio", None, 0.5),
)
def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _held(rules: Sequence[Rule]) -> Column:
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (F.col(r.measure) >= r.low)
        if r.high is not None:
            out = out & (F.col(r.measure) <= r.high)
    return out


def measured(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`carry` columns, then the measures that rules may name, of each whole text.

    Repeated phrases: 64-bit hashes of the 3-word windows are sorted with their positions inside the row, so a
    long text costs n log n; the work is skipped where all windows differ.
    """
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    names = [f"carry_{i}" for i in range(len(carry))]
    t = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("*", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    t = t.select(
        *names, "w", "lines",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(stops))).alias("n_stops"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("tri"),
    )
    t = t.drop("w", "lines").withColumn("s", F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"])
    t = t.drop("tri").withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    t = t.drop("s").withColumn("spread", F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))))
    # The last term is 0. It keeps a filter on the result above these steps: pushed below, it would inline each
    # array into the lambdas that read it and compute it once per element.
    above = F.least(F.lit(0), F.monotonically_increasing_id())
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate("spread", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long") + above)
    return t.select(
        *(F.col(n).alias(c) for c, n in zip(carry, names)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_stops", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`measured` with base_failed (too short, or mostly repeated phrases) and kept (not that, and every rule of the table holds)."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, text, carry).withColumn("base_failed", base).withColumn("kept", ~base & _held(rules))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs` that every rule keeps, with all their columns, in one pass without a join."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("text").alias("text"))
    return judged(row, rules, carry=("whole",)).where("kept").select("whole.*")


def op1_quality_rules(spark, sf_dir):
    from .common import documents

    out = judged(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS_SQL = ", ".join("'" + v + "'" for w in STOP_WORDS for v in (w, w.capitalize()))

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOPS_SQL}))) AS n_stops
  FROM d LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols / n_words <= 0.1 AND word_chars / n_words BETWEEN 2 AND 20
       AND n_stops / n_words >= 0.01 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""
