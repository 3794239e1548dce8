"""Secrets in texts, in DataFrame functions throughout: exact patterns, and strings that look random to two Markov models.

Base patterns find assignments to names like "password", access keys and long runs of hexadecimal digits. What they do not know is
found by form: runs of at least `LEAST` letters, digits and the signs of the usual encodings, and the runs of letters and
digits alone inside them, are candidates. Two character Markov models, one of random strings and one of ordinary identifiers, give
each candidate a log-likelihood ratio: the sum over neighbouring characters, start and end included, of what the one model says of the
second after the first against the other. A candidate whose sum is above the threshold is a span of kind "random", unless it lies
in a base span or in a longer candidate that is one.

Both models are tables of character pairs, counted by Spark over labelled strings, so the driver gets one number per pair and
label. The labelled strings come from a hashed sample of about `sample_docs` documents. Random ones: what the base patterns mark there,
and digests in hexadecimal, base64 and its URL form, letters and digits of both cases, and upper case alone, one a document. Ordinary
ones: the sample's words and numbers outside base spans, each distinct one once; every three words in a row as the names that programs make of
them (snake, kebab and camel case, paths, with numbers behind); a sign or two repeated; and signs in the order of the alphabet. Half of the sample's documents train the models.
On the other half the threshold is set so that at most `false_share` of the ordinary strings pass, and recall is
reported, form by form, for random ones. Ratios are whole thousandths of a bit, so that sums do not depend on their order.

Defined cases: a null text is empty and has no spans; positions count code points, ends are exclusive; without any strings of one label the
base spans stand alone; rows that repeat are treated alike; other columns are ignored unless carried. Every pattern reads a
run of its characters a bounded number of times, so very long texts cost their length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import redacted_text, table, written
from .pii import _found

KINDS = ("assign", "access", "hex", "random")
SEED, SAMPLE_DOCS, LEAST, FALSE_SHARE = 42, 4000, 16, 0.0005

#: Fixed patterns.
_NAME = r"(?i)(password|passwd|secret|token|api_?key)(?-i)"
ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # what is shorter ends where its run ends, and nothing later in the run is longer
HEX = r"[0-9a-f]{24,}"

_SIGNS = "A-Za-z0-9+/_=-"
RUN = rf"(?<![{_SIGNS}])[{_SIGNS}]{{{LEAST},}}+"
PIECE = rf"(?<![A-Za-z0-9])[A-Za-z0-9]{{{LEAST},}}+"

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of the models; 0 is the start and the end of a string.
SYMBOLS = len(_LETTERS) + 1
_CODES = [_LETTERS.find(chr(i)) + 1 for i in range(128)]
#: Forms of random strings, for the training sample.
FORMS = ("marked", "hex", "upper_hex", "base64", "url", "alphanumeric", "upper", "lower")


def _numbers(values: Sequence[int]) -> Column:
    """An array of whole numbers as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _code(c: Column) -> Column:
    return F.element_at(_numbers(_CODES), F.ascii(c) + 1)


def ratio(s: Column, ratios: Sequence[int]) -> Column:
    """The log-likelihood ratio of a string, in thousandths of a bit: one pass over its characters."""
    table_ = _numbers(ratios)
    at = lambda a, b: F.element_at(table_, a * SYMBOLS + b + 1)
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"))
    seen = lambda a, x: F.struct(x.alias("last"), (a["sum"] + at(a["last"], x)).alias("sum"))
    return F.aggregate(_chars(s), start, lambda a, c: seen(a, _code(c)), lambda a: a["sum"] + at(a["last"], F.lit(0)))


def base_spans(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """_row (a struct of `carry`), the text as t, and the base spans of each kind (assign, access, hex)."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = _found(d, "assign", ASSIGN, F.col("t").rlike(_NAME))
    d = d.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6))
    d = _found(d, "access", ACCESS, F.col("t").contains("AKIA"))
    return _found(d, "hex", HEX, F.col("t").rlike(HEX))


def labelled(picked: DataFrame) -> DataFrame:
    """half, good (1: random, 0: ordinary), form and the string s, from `picked` (half, id, text)."""
    d = written(base_spans(picked, ("half", "id")).select("_row.*", "t", F.concat(F.transform("assign", lambda x: F.regexp_extract(x["match"], ASSIGN, 2)), F.transform("access", lambda x: x["match"]), F.transform("hex", lambda x: x["match"])).alias("marked")), "marked")
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.length(s) >= LEAST)
    marked = d.select("half", F.lit("marked").alias("form"), F.explode(F.filter("marked", mixed)).alias("s"))
    digest = F.sha2(F.concat_ws(":", F.lit(SEED), F.col("id")).cast("binary"), 256)
    b64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(b64, "[^A-Za-z0-9]", "")
    forms = F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 32)), b64, F.regexp_replace(F.translate(b64, "+/", "-_"), "=", ""), plain, F.substring(F.upper(plain), 1, 24), F.substring(F.lower(plain), 1, 32))
    which = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(len(FORMS) - 1)).cast("int")
    made = d.select("half", F.element_at(F.array(*map(F.lit, FORMS[1:])), which + 1).alias("form"), F.element_at(forms, which + 1).alias("s"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = written(d.select("half", F.regexp_extract_all(clean, F.lit(f"[{_SIGNS}]{{3,}}"), F.lit(0)).alias("w")), "words")
    single = words.select("half", F.lit("word").alias("form"), F.explode("w").alias("s")).distinct()
    thirds = F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)
    three = words.where(F.size("w") >= 3).select("half", F.explode(F.transform(thirds, lambda i: F.slice("w", i * 3 + 1, 3))).alias("w"))
    a, b, c = (F.col("w")[i] for i in range(3))
    number = F.pmod(F.xxhash64("w"), F.lit(3000)).cast("string")
    signs, place = F.lit(_LETTERS), F.pmod(F.xxhash64("w", F.lit(SEED + 2)), F.lit(len(_LETTERS))).cast("int") + 1
    names = F.array(F.concat_ws("_", a, b, c), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", F.lower(a), F.lower(b), F.lower(c)), F.concat(F.lower(a), F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c), number), F.concat_ws("/", a, b, c), F.concat_ws("_", a, b, number, number), F.repeat(F.substring(signs, place, 1), 20), F.repeat(F.substring(a, 1, 2), 12), F.substring(signs, place, 20))
    named = three.select("half", F.lit("name").alias("form"), F.element_at(names, F.pmod(F.xxhash64("w", F.lit(SEED)), F.lit(10)).cast("int") + 1).alias("s"))
    random = marked.unionByName(made).withColumn("good", F.lit(1))
    return random.unionByName(single.unionByName(named).withColumn("good", F.lit(0))).select("half", "good", "form", "s")


class Model(NamedTuple):
    """Thousandths of a bit for each pair of characters, the threshold, and on the held-out half (share of ordinary strings that pass, {form: recall})."""

    ratios: list[int]
    least: int
    quality: tuple[float, dict[str, float]]


def pair_counts(strings: DataFrame) -> list[list[float]]:
    """For ordinary and for random `strings` (good, s), how often each pair of characters stands there; at most two numbers a pair are collected."""
    codes = strings.select("good", F.concat(F.array(F.lit(0)), F.transform(_chars(F.col("s")), _code), F.array(F.lit(0))).alias("c"))
    n = F.size("c") - 1
    pairs = codes.select("good", F.explode(F.zip_with(F.slice("c", 1, n), F.slice("c", 2, n), lambda a, b: a * SYMBOLS + b)).alias("pair"))
    out = [[0.0] * (SYMBOLS * SYMBOLS) for _ in range(2)]
    for r in pairs.groupBy("good", "pair").count().collect():
        out[r.good][r.pair] = float(r["count"])
    return out


def log_ratios(counts: list[list[float]], smooth: float = 0.5) -> list[int]:
    """log2 of the probability of a character after another among random strings against ordinary ones, in thousandths."""
    shares = []
    for n in counts:
        rows = [sum(n[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
        shares.append([(x + smooth) / (rows[i // SYMBOLS] + smooth * SYMBOLS) for i, x in enumerate(n)])
    return [round(1000 * math.log2(r / o)) for o, r in zip(*shares)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, false_share: float = FALSE_SHARE, forms: Sequence[str] = FORMS) -> Model | None:
    """The models from `docs` (doc_id, text); None where one label has no strings. Random forms that `forms` leaves out are held out of training alone."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    mark = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    picked = docs.where(mark < int(share * (1 << 30))).select((mark % 2).alias("half"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    strings = written(labelled(picked), "strings")
    counts = pair_counts(strings.where((F.col("half") == 0) & ((F.col("good") == 0) | F.col("form").isin(list(forms)))))
    if not all(map(sum, counts)):
        return None
    ratios = log_ratios(counts)
    scored = strings.where((F.col("half") == 1) & (F.length("s") >= LEAST)).select("form", "good", F.floor(ratio(F.col("s"), ratios) / 1000).alias("bits"))
    told = sorted(tuple(r) for r in scored.groupBy("good", "form", "bits").count().collect())  # a row per form and whole bit
    ordinary = sorted(((bits, n) for good, _, bits, n in told if not good), reverse=True)
    total, over, least = sum(n for _, n in ordinary), 0, 0
    for bits, n in ordinary:
        if over + n > false_share * total:
            least = max(0, bits + 1)
            break
        over += n
    passed = sum(n for bits, n in ordinary if bits >= least)
    recall = {f: sum(n for g, form, b, n in told if g and form == f and b >= least) / whole for f in FORMS if (whole := sum(n for g, form, _, n in told if g and form == f))}
    return Model(ratios, 1000 * least, (passed / total if total else 0.0, recall))


def found(docs: DataFrame, model: Model | None, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """_row (a struct of `carry`), t (the text), base and spans: arrays of (start, kind, end) in order, kinds numbered as in KINDS."""
    span = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    d = base_spans(docs, carry, text)
    d = d.withColumn("base", F.sort_array(F.concat(*(F.transform(k, span(i)) for i, k in enumerate(KINDS[:3])))))
    if model is None:
        return d.select("_row", "t", "base", F.col("base").alias("spans"))
    random = lambda x: ratio(x["match"], model.ratios) >= model.least
    inside = lambda x, of: F.exists(of, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))
    d = _found(d, "_run", RUN, F.col("t").rlike(RUN))
    d = _found(d, "_piece", PIECE, F.size("_run") > 0)
    d = d.withColumn("_run", F.filter("_run", lambda x: ~inside(x, "base") & random(x)))
    d = d.withColumn("_piece", F.filter("_piece", lambda x: ~inside(x, "base") & ~inside(x, "_run") & random(x)))
    return d.select("_row", "t", "base", F.sort_array(F.concat("base", F.transform("_run", span(3)), F.transform("_piece", span(3)))).alias("spans"))


def redacted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    spans = found(docs, model, docs.columns, text)
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    stretches = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(tags, x["kind"] + 1).alias("tag")))
    cleaned = F.when(F.size("spans") > 0, redacted_text(F.col("t"), stretches)).otherwise(F.col(f"_row.`{text}`"))
    return spans.select(*(cleaned.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op11_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = found(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return spans.select("_row.doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
