"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers exactly. Generators of high recall
propose more, overlapping spans: written-out addresses, numbers with any separators, the digit groups inside such
numbers and their windows of 8 to 19 digits, and values after words like "password", to their end. Form, context and the
kind's own check (check digit, ranges, digit count) become small whole-number features; trees boosted on logistic loss score each
candidate, and those at or above their kind's threshold join the base spans. Generators, features, trees and thresholds are one
projection over the text: nothing is shuffled, and positions come from prefix sums over the pieces between matches.

The trees learn from all documents, in which the base patterns mark what is personal. Each
marked span is written into its own context in several other forms (addresses spelled out, cards in groups with odd separators,
telephone numbers without "+"), which are examples; decoys made of it in the same forms (a wrong check digit, too large a part,
a date or a bare run of digits, a sentence with "at" in brackets), candidates that have a part of a span or more than it, and those
that touch no span and fail their check are counter-examples. Secrets have no base pattern: a value with several changes between
letters and digits is an example, and so is any value after a password word; letters alone after other words are none.
The driver fits the trees to counts of distinct feature rows, whose number is bounded by the features' bins, over one half of all
documents by a hash of their ids; thresholds are set on the other half, for a precision of `precision` at least, and recall is reported.

Defined cases: a null text is empty and has no spans; positions count code points; kinds come in the order listed;
without candidates, or with one label only, the base spans stand alone; rows that repeat are treated
alike; other columns are ignored. Patterns start at the head of a run of their characters, so that very long runs
cost their length and not its square.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import redacted_text, table_partitions, written

KINDS = ("email", "ip", "card", "phone", "secret")
SEED, PRECISION = 42, 0.98
#: Names of the columns that results have.
_OWN = {"t", "candidates", *KINDS, *(f"{p}_{k}" for p in ("base", "all") for k in KINDS)}

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, greedy parts possessive where no way back can succeed.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Generators: kind of the candidate is told from its form.
LOOSE_ADDRESS = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}+){1,8}+"
LOOSE_NUMBER = r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+"
LOOSE_SECRET = r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?[A-Za-z0-9_+/=-]{8,}+"
#: Words before a candidate that tell its kind.
CUES = ("phone|tel|call|fax|mobile", "card|visa|account", "ip|host|server|addr", "mail|contact|write")
FEATURES = ("n_digits", "n_groups", "longest", "n_letters", "n_dots", "n_stops", "n_marks", "changes", "size", "cue", "glued", "form", "kind", "valid")


def prefix_sums(x: Column, block: int = 512) -> Column:
    """Running sums of an array of whole numbers; summed in blocks, so that long arrays are not copied per element."""
    add = lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))
    sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, y: a + y))
    bases = F.aggregate(sums, F.array(F.lit(0)), add)
    runs = F.zip_with(bases, parts, lambda b, p: F.when(p.isNotNull(), F.slice(F.aggregate(p, F.array(b), add), 2, block)))
    return F.when(F.size(x) > 0, F.flatten(F.filter(runs, lambda r: r.isNotNull()))).otherwise(F.array().cast("array<int>"))


def _found(docs: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds `name`: structs of start, end (code points, end exclusive), match and the 24 characters before it."""
    docs = docs.withColumn("_m", F.when(guard, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("_p", F.when(F.size("_m") > 0, F.slice(F.split("t", pattern), 1, F.size("_m"))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("_n", F.zip_with("_p", "_m", lambda p, m: F.length(p) + F.length(m)))
    docs = docs.withColumn("_e", prefix_sums(F.col("_n")))
    both = F.zip_with("_m", "_p", lambda m, p: F.struct(m.alias("match"), F.substring(p, -24, 24).alias("before")))
    spans = F.zip_with(both, "_e", lambda x, e: F.struct((e - F.length(x["match"])).alias("start"), e.alias("end"), x["match"].alias("match"), x["before"].alias("before")))
    return docs.withColumn(name, spans).drop("_m", "_p", "_n", "_e")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; whatever is not a digit must be gone."""
    turned = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))
    return F.aggregate(F.transform(F.filter(turned, lambda c: c != ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _card(s: Column) -> Column:
    return F.when(F.length(_digits(s)).between(16, 19), luhn(_digits(s))).otherwise(False)


def _phone(s: Column) -> Column:
    return F.length(_digits(s)).between(8, 15)


def carried(carry: Sequence[str]) -> list[str]:
    """The names that carried columns get: their own, with "_carried" behind it where the results here have that name."""
    return [f"{c}_carried" if c in _OWN or c.startswith("_") else c for c in carry]


def base_spans(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry` (named as `carried` says), the text as t, and the base spans of each kind (email, ip, card, phone)."""
    d = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried(carry))), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = _found(d, "email", EMAIL, F.col("t").contains("@"))
    d = _found(d, "ip", IP, F.col("t").rlike(r"[0-9]\.[0-9]"))
    d = _found(d, "card", CARD, F.col("t").rlike(r"[0-9](?:[\x20-]?[0-9]){15}"))
    d = _found(d, "phone", PHONE, F.col("t").contains("+"))
    d = d.withColumn("ip", F.filter("ip", lambda x: x["match"].rlike(VALID_IP)))
    d = d.withColumn("card", F.filter("card", lambda x: _card(x["match"])))
    return d.withColumn("phone", F.filter("phone", lambda x: _phone(x["match"])))


def _count(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, f"[{chars}]", ""))


def _described(x: Column, form: int) -> Column:
    """A candidate with its features, among them its kind and whether it passes that kind's own check."""
    m, digits = x["match"], _digits(x["match"])
    cue = F.coalesce(*(F.when(x["before"].rlike(rf"(?i)\b(?:{c})"), i + 1) for i, c in enumerate(CUES)), F.lit(0))
    if form == 0:
        kind, valid = F.lit(0), m.rlike(f"^(?:{EMAIL})$")
    elif form == 2:
        value = _value(m)
        kind, valid, cue = F.lit(4), value.rlike("[0-9]") & value.rlike("[A-Za-z]"), F.when(m.rlike("(?i)^(?:pass|pwd)"), 5).otherwise(6)
    else:
        kind = F.when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 1).when(F.length(digits) >= 16, 2).otherwise(3)
        valid = F.when(kind == 1, m.rlike(VALID_IP)).when(kind == 2, _card(m)).otherwise(m.rlike(f"^(?:{PHONE})$") & _phone(m))
    groups = F.split(m, "[^0-9]+")
    features = {
        "n_digits": F.least(F.length(digits), F.lit(24)), "n_groups": F.least(F.size(F.filter(groups, lambda g: g != "")), F.lit(9)),
        "longest": F.least(F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), F.lit(20)),
        "n_letters": F.least(_count(m, "A-Za-z"), F.lit(24)), "n_dots": F.least(_count(m, "."), F.lit(5)), "n_stops": F.least(F.regexp_count(m, F.lit(r"\. ")), F.lit(5)),
        "n_marks": F.least(_count(m, r"\x20()/\-"), F.lit(8)), "changes": F.least(_changes(m), F.lit(9)),
        "size": F.least(F.floor(F.length(m) / 2), F.lit(24)), "cue": cue, "glued": x["before"].rlike("[A-Za-z0-9]$"), "form": F.lit(form), "kind": kind, "valid": valid,
    }
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), *(features[n].cast("int").alias(n) for n in FEATURES))


def _value(secret: Column) -> Column:
    return F.regexp_replace(secret, r"^[^=:]*[=:]\x20{0,2}[\"']?", "")


def _changes(s: Column) -> Column:
    """How often a digit follows a letter or a letter a digit."""
    return F.regexp_count(s, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))


def _inner(docs: DataFrame, runs: str, name: str) -> DataFrame:
    """Adds `name`, in the form of `_found`: what lies inside the numbers `runs` that have several digit groups.

    These are windows of consecutive groups with 8 to 19 digits, and single groups of 7 digits or more (a number has no
    fewer). Window texts are joined from their own pieces, so that a long run costs its length.
    """
    several = F.filter(runs, lambda x: x["match"].rlike("[0-9][^0-9]+[0-9]"))
    cut = lambda x: F.struct(x["start"].alias("start"), x["before"].alias("before"), F.split(x["match"], "[0-9]+").alias("marks"), F.filter(F.split(x["match"], "[^0-9]+"), lambda g: g != "").alias("groups"))
    part = lambda m, g: F.struct(m.alias("mark"), g.alias("group"), F.length(m).alias("m"), F.length(g).alias("n"))
    parts = lambda x: F.struct(x["start"].alias("start"), x["before"].alias("before"), F.zip_with(F.slice(x["marks"], 1, F.size(x["groups"])), x["groups"], part).alias("parts"))
    lengths = lambda x: F.struct(*(x[c].alias(c) for c in ("start", "before", "parts")), F.transform(x["parts"], lambda p: F.concat(p["mark"], p["group"])).alias("texts"), F.transform(x["parts"], lambda p: p["n"]).alias("n"), F.transform(x["parts"], lambda p: p["m"] + p["n"]).alias("size"))
    sums = lambda x: F.struct(*(x[c].alias(c) for c in ("start", "before", "parts", "texts")), prefix_sums(x["n"]).alias("digits"), prefix_sums(x["size"]).alias("ends"))

    def heads(x: Column) -> Column:
        def head(p: Column, i: Column) -> Column:
            lead = F.regexp_extract(p["mark"], "[+(]$", 0)
            left = F.array_join(F.slice(x["texts"], F.greatest(i - 24, F.lit(0)) + 1, F.least(i, F.lit(24))), "")
            before = F.substring(F.concat(x["before"], left, F.regexp_replace(p["mark"], "[+(]$", "")), -24, 24)
            return F.struct(i.alias("i"), F.concat(lead, p["group"]).alias("text"), (F.get(x["ends"], i) - p["n"] - F.length(lead)).alias("at"), (F.get(x["digits"], i) - p["n"]).alias("done"), before.alias("before"))

        return F.transform(x["parts"], head)

    def windows(x: Column) -> Column:
        last = F.size(x["parts"]) - 1

        def of(h: Column) -> Column:
            def wanted(j: Column) -> Column:
                n = F.get(x["digits"], j) - h["done"]
                return (n.between(8, 19) | ((j == h["i"]) & (n >= 7))) & ~((h["i"] == 0) & (j == last))

            span = lambda j: F.struct((x["start"] + h["at"]).alias("start"), (x["start"] + F.get(x["ends"], j)).alias("end"), F.concat(h["text"], F.array_join(F.slice(x["texts"], h["i"] + 2, j - h["i"]), "")).alias("match"), h["before"].alias("before"))
            return F.transform(F.filter(F.sequence(h["i"], F.least(h["i"] + 18, last)), wanted), span)

        return F.flatten(F.transform(heads(x), of))

    return docs.withColumn(name, F.flatten(F.transform(F.transform(F.transform(F.transform(F.transform(several, cut), parts), lengths), sums), windows)))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds `candidates`, of all generators, to the result of `base_spans`."""
    d = _found(docs, "_g0", LOOSE_ADDRESS, F.col("t").rlike(r"@|(?i)[\[({] ?at ?[\])}]"))
    d = _found(d, "_g1", LOOSE_NUMBER, F.col("t").rlike(r"[0-9](?:[\x20().\-/]{0,2}[0-9]){6}"))
    d = _found(d, "_g2", LOOSE_SECRET, F.col("t").rlike(r"(?i)pass|pwd|token|secret|key"))
    d = _inner(d, "_g1", "_g3")
    of = lambda form: lambda x: _described(x, form)
    return d.withColumn("candidates", F.concat(*(F.transform(f"_g{i}", of(i)) for i in range(4)))).drop("_g0", "_g1", "_g2", "_g3")


class Trees:
    """Gradient-boosted trees over small whole-number features, fitted to weighted distinct rows."""

    def __init__(self, n_trees: int = 40, depth: int = 4, rate: float = 0.3, least: float = 1.0):
        self.n_trees, self.depth, self.rate, self.least = n_trees, depth, rate, least
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> Trees:
        share = np.clip(positive.sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        z = np.full(len(x), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * p - positive, weight * p * (1 - p)
            tree = self._grown(x, g, h, np.arange(len(x)), self.depth)
            self.trees.append(tree)
            z += self._of(tree, x)
        return self

    def _grown(self, x, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(-self.rate * total_g / (total_h + self.least))
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if depth else ():
            v = x[rows, f]
            gs, hs = np.bincount(v, g[rows]).cumsum()[:-1], np.bincount(v, h[rows]).cumsum()[:-1]
            if not len(gs):
                continue
            gain = gs**2 / (hs + self.least) + (total_g - gs) ** 2 / (total_h - hs + self.least) - total_g**2 / (total_h + self.least)
            gain[(hs < 0.1) | (total_h - hs < 0.1)] = 0
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (float(gain[cut]), f, cut)
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grown(x, g, h, rows[low], depth - 1), self._grown(x, g, h, rows[~low], depth - 1)

    def _of(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        return np.where(x[:, f] <= cut, self._of(a, x), self._of(b, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Added in the order of `column`: a threshold is one of these scores and must be met to the last bit."""
        return sum((self._of(t, x) for t in self.trees), np.full(len(x), self.start))

    def column(self, row: Column) -> Column:
        """The score as an expression over a struct that has the features."""

        def node(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            return F.when(row[FEATURES[tree[0]]] <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        return sum((node(t) for t in self.trees), F.lit(self.start))


def thresholds(score: np.ndarray, kind: np.ndarray, positive: np.ndarray, weight: np.ndarray, precision: float = PRECISION) -> list[float]:
    """For each kind the score from which on the candidates' precision is as asked, and the odds at least even; infinite if there is none.

    It lies midway between the last score that is taken and the next lower one.
    """
    out = []
    for k in range(len(KINDS)):
        of = kind == k
        order = np.argsort(-score[of], kind="stable")
        s, p, w = score[of][order], positive[of][order].cumsum(), weight[of][order].cumsum()
        good = np.flatnonzero((p >= precision * w) & (s >= 0) & np.append(s[1:] != s[:-1], True)[: len(s)])
        below = s[good[-1] + 1] if len(good) and good[-1] + 1 < len(s) else 0.0
        out.append(float(max((s[good[-1]] + below) / 2, 0.0)) if len(good) else math.inf)
    return out


def _forms(kind: Column, m: Column) -> Column:
    """Other forms of a span, as structs of form and whether it is an example; the rest are decoys."""
    d, local, host = _digits(m), F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    fours = lambda x, mark: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{mark}")
    wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((F.substring(d, -1, 1).cast("int") + 1) % 10).cast("string"))
    letters = F.concat(F.regexp_replace(_value(m), "[^A-Za-z]", ""), F.lit("abcdefgh"))
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(F.xxhash64(m), F.lit(9000)).cast("int")), "yyyy-MM-dd")
    forms = [
        [(m, 1), (F.concat(local, F.lit(" [at] "), F.regexp_replace(host, r"\.", " [dot] ")), 1), (F.concat(local, F.lit("(at)"), host), 1), (F.concat(local, F.lit(" {at} "), F.regexp_replace(host, r"\.", " (dot) ")), 1),
         (F.concat(F.regexp_replace(local, "[^A-Za-z]", ""), F.lit(" (at) "), F.substring_index(host, ".", 1), F.lit(". And")), 0), (F.concat(F.lit("look [at] "), F.regexp_replace(F.substring_index(host, ".", 1), "[0-9]", ""), F.lit(". The")), 0)],
        [(m, 1), (F.concat(F.substring_index(m, ".", 3), F.lit(".999")), 0), (F.regexp_replace(m, "^[0-9]+", "300"), 0)],
        [(m, 1)] + [(fours(x, mark), good) for mark in ("/", "  ", ".", " ", "-", "") for x, good in ((d, 1), (wrong, 0))],
        [(m, 1), (F.substring(m, 2, 100), 1), (F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]*", ""), 1), (F.regexp_replace(F.substring(m, 2, 100), "[^0-9]+", "."), 1), (F.regexp_replace(F.substring(m, 2, 100), "[^0-9]+", " "), 1), (F.regexp_replace(F.substring(m, 2, 100), "[^0-9]+", "-"), 1),
         (d, 0), (F.concat(day, F.lit(" 10")), 0), (F.concat(day, F.lit("-"), F.substring(d, -4, 4)), 0), (fours(F.substring(F.concat(d, d), 1, 12), " "), 0)],
        [(m, 1), (F.concat(F.lit("password: "), letters), 1), (F.concat(F.lit("pwd="), letters), 1), (F.concat(F.lit("token = "), letters), 0), (F.concat(F.lit("secret: "), letters), 0), (F.concat(F.lit("api key: "), letters), 0)],
    ]
    of = [F.array(*(F.struct(text.alias("text"), F.lit(good).alias("good")) for text, good in x)) for x in forms]
    return F.when(kind == 0, of[0]).when(kind == 1, of[1]).when(kind == 2, of[2]).when(kind == 3, of[3]).otherwise(of[4])


def examples(docs: DataFrame) -> DataFrame:
    """half, which, the features and good (1 or 0) of the candidates that can be told, from `docs` (half, text).

    `which` is the form that an example or decoy was written in, a hundred times its kind and its place in `_forms`; -1 for what stands in the text itself.
    """
    base = lambda k, i: F.transform(k, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before")))
    secret = lambda x: _changes(_value(x["match"])) >= 3
    d = candidates(base_spans(docs, ("half",)))
    d = _found(d, "secret", LOOSE_SECRET, F.col("t").rlike(r"(?i)pass|pwd|token|secret|key"))
    d = d.select("half", F.concat(*(base(k, i) for i, k in enumerate(KINDS[:4])), base(F.filter("secret", secret), 4)).alias("marked"), "candidates")
    d = written(d, "marked")
    # An outer explode: before another one Spark tests the array at the scan, and would make all candidates twice.
    plain = d.select("half", F.transform("marked", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"), F.explode_outer("candidates").alias("c")).where("c is not null and c.valid = 0")
    apart = plain.where(~F.exists("spans", lambda x: (x["start"] < F.col("c.end")) & (F.col("c.start") < x["end"]))).select("half", F.lit(-1).alias("which"), "c", F.lit(0).alias("good"))
    spans = d.select("half", F.explode_outer("marked").alias("x")).where("x is not null")
    spans = spans.select("half", F.col("x.kind").alias("of"), F.col("x.before").alias("before"), F.posexplode(_forms(F.col("x.kind"), F.col("x.match"))).alias("place", "form"))
    # Alone and with another number or address behind it, in one run with which it must be told as a part.
    spans = spans.select("half", (F.col("of") * 100 + F.col("place")).alias("which"), "before", "form", F.explode(F.array(*map(F.lit, (" ;", " 20871543 ;", " 27.204.213.132 ;")))).alias("after"))
    made = spans.select("half", "which", "form.good", F.length("before").alias("at"), (F.length("before") + F.length("form.text")).alias("to"), F.concat("before", "form.text", "after").alias("t"))
    dealt = written(made, "forms").repartition(table_partitions(docs.sparkSession))  # its files are few, its candidates many
    c = candidates(dealt).select("half", "which", "good", "at", "to", F.explode_outer("candidates").alias("c")).where("c is not null")
    whole = (F.col("c.start") == F.col("at")) & (F.col("c.end") == F.col("to"))
    part = (F.col("good") == 1) & (F.col("c.start") < F.col("to")) & (F.col("c.end") > F.col("at"))
    told = c.where(whole | part).select("half", "which", "c", F.when(whole, F.col("good")).otherwise(0).alias("good"))
    return apart.unionByName(told).select("half", "which", *(f"c.{f}" for f in FEATURES), "good")


class Model(NamedTuple):
    """Trees, each kind's threshold, and on the held-out half each kind's (precision, recall, examples) of what the threshold selects.

    `unseen` is the same on the forms that training was told to leave out.
    """

    trees: Trees
    least: list[float]
    quality: dict[str, tuple[float, float, int]] = {}
    unseen: dict[str, tuple[float, float, int]] = {}


def train(docs: DataFrame, precision: float = PRECISION, unseen: Sequence[int] = ()) -> Model | None:
    """Trees and thresholds from `docs` (doc_id, text); None where they have no candidates of both labels.

    Forms in `unseen`, numbered as `examples` does, neither train the trees nor set thresholds: they tell how both do on forms that are new.
    """
    mark = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    counted = examples(docs.select((mark % 2).alias("half"), "text")).withColumn("new", F.col("which").isin(list(unseen)).cast("int") if unseen else F.lit(0)).groupBy("half", "new", *FEATURES).agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    rows = sorted(counted.collect(), key=lambda r: tuple(r[:-2]))
    half, new, kind, n, good = (np.array([r[f] for r in rows], np.int64) for f in ("half", "new", "kind", "n", "good"))
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(-1, len(FEATURES))
    fit, rest, apart = (half == 0) & (new == 0), (half == 1) & (new == 0), (half == 1) & (new == 1)
    if not 0 < good[fit].sum() < n[fit].sum():
        return None
    trees = Trees().fit(x[fit], good[fit].astype(float), n[fit].astype(float))
    score = trees.score(x)
    least = thresholds(score[rest], kind[rest], good[rest], n[rest], precision)

    def quality(rows: np.ndarray) -> dict[str, tuple[float, float, int]]:
        out = {}
        for k, name in enumerate(KINDS):
            of = rows & (kind == k)
            taken = of & (score >= least[k])
            all_good, hits, got = int(good[of].sum()), int(good[taken].sum()), int(n[taken].sum())
            out[name] = (hits / got if got else 1.0, hits / all_good if all_good else 0.0, all_good)
        return out

    return Model(trees, least, quality(rest), quality(apart) if unseen else {})


def found(docs: DataFrame, model: Model | None, carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry`, t (the text), base: arrays of base spans by kind, and spans: by kind, base ones and those added."""
    d, carry = base_spans(docs, carry, text), carried(carry)
    edge = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    if model is None:
        return d.select(*carry, "t", *(edge(k).alias(f"base_{k}") for k in KINDS[:4]), *(edge(k).alias(f"all_{k}") for k in KINDS[:4]), F.array().cast("array<struct<start:int,end:int>>").alias("all_secret"))
    trees, least = model[:2]
    limit = lambda c: F.element_at(F.array(*(F.lit(min(x, 1e9)) for x in least)), c["kind"] + 1)
    d = candidates(d).withColumn("_new", F.filter("candidates", lambda c: trees.column(c) >= limit(c)))
    new = lambda i: F.transform(F.filter("_new", lambda c: c["kind"] == i), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    joined = [F.array_distinct(F.sort_array(F.concat(edge(k), new(i)))).alias(f"all_{k}") for i, k in enumerate(KINDS[:4])]
    return d.select(*carry, "t", *(edge(k).alias(f"base_{k}") for k in KINDS[:4]), *joined, F.sort_array(new(4)).alias("all_secret"))


def redacted(spans: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`carry` and text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    tag = lambda k: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag"))
    tagged = F.concat(*(F.transform(f"all_{k}", tag(k)) for k in KINDS))
    return spans.select(*carry, F.when(F.size(tagged) > 0, redacted_text(F.col("t"), F.sort_array(tagged))).otherwise(F.col("t")).alias("text"))


def _joined(prefix: str, kinds: Sequence[str]) -> Column:
    named = lambda k: lambda x: F.concat_ws(":", F.lit(k), x["start"], x["end"])
    parts = [F.transform(f"{prefix}_{k}", named(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def op4_pii(spark, sf_dir):
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = found(docs, train(docs))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return spans.select("doc_id", *counts, F.sha2(_joined("base", KINDS[:4]), 256).alias("base_sha256"), _joined("all", KINDS).alias("spans"))
