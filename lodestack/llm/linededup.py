"""Line dedup through a sharded minimal perfect hash.

Every line of a text that is long enough becomes a 64-bit hash and a 32-bit fingerprint. Each batch of documents is
combined to one row per line that it has, with the least doc_id and the number of documents; these rows go to the line's
shard. There one task builds a minimal perfect hash (levels of bit arrays) over the shard's distinct line hashes and
adds the rows up in arrays at the hashes' slots: fingerprint, document count and owner, the least doc_id. That table of
shards is the index. The documents' lines are then sent to their shard as hashes and place, behind the shard's arrays,
and probe them as they stream by, so that a task holds one shard's arrays and one batch. A line goes if its slot has the
fingerprint, a count of at least `least` and another owner. What comes back per document is the places of the lines that go, and the
text is put together from the stretches between them, in time that is linear in its lines.

A line that a third of all documents share is one row per batch on its way into the index, and its probes are spread over
as many tasks as its shard's rows need.

Defined cases: a null or empty text is one empty line; keys under `shortest` code points always stay; documents
with a null doc_id keep every line and count for nobody; rows that repeat one doc_id are one document as far as owners go
(a count tells rows); ties cannot be, since the owner is the least doc_id; an empty table gives an empty result; other columns
are kept by `deduplicated` under any name, but for n_lines and n_dropped, which it replaces where it adds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table_partitions, written

#: Lines of one shard (about 17 bytes of arrays for each that is distinct), and the most lines sent to one task, on the average.
SHARD_LINES, TASK_LINES = 50_000, 200_000
STEP = 0x9E3779B97F4A7C15


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    trimmed = F.regexp_replace(line, "^[\\x20\\x09-\\x0D]+|(?<![\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]+$", "")
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ np.uint64((level + 1) * STEP & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Level bit arrays: a key takes the first level where no other key left falls on its bit; its slot is the bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            words = np.zeros(max(1, -(-2 * len(left) // 64)), np.uint64)
            at = _mixed(left, len(levels)) % np.uint64(64 * len(words))
            alone = np.bincount(at.astype(np.int64), minlength=64 * len(words))[at.astype(np.int64)] == 1
            np.bitwise_or.at(words, (at[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at[alone] & np.uint64(63)))
            levels.append(words)
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, its own for those it was built over; -1 where no level has its bit."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for n, words in enumerate(self.levels):
            at = _mixed(keys[left], n) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (words[word] >> bit & np.uint64(1)).astype(bool)
            low = words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = self.ranks[base + word[here]] + np.bitwise_count(low)
            left, base = left[~here], base + len(words)
            if not len(left):
                break
        return out

    def packed(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.uint64)
        return np.concatenate([sizes, *self.levels]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        x = np.frombuffer(data, np.uint64)
        sizes = x[1 : int(x[0]) + 1].astype(np.int64)
        return cls(np.split(x[len(sizes) + 1 :], np.cumsum(sizes)[:-1]) if len(sizes) else [])


def _row(text: Column) -> Column:
    """With doc_id it tells rows with different texts apart; rows that are alike lose the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, shortest: int = 10) -> DataFrame:
    """doc_id (long) and row, with place, h (hash) and f (fingerprint) of each line that is long enough, as arrays. Rows without doc_id are left out."""
    # No filter on the arrays: Spark would make them once more below it.
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), _row(F.col("text")).alias("row"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), line_key(x).alias("key"))).alias("lines"))
    lines = lines.select("doc_id", "row", F.filter("lines", lambda x: F.length(x["key"]) >= shortest).alias("lines"))
    return lines.select("doc_id", "row", F.transform("lines", lambda x: x["i"]).alias("place"), F.transform("lines", lambda x: F.xxhash64(x["key"])).alias("h"), F.transform("lines", lambda x: F.hash(x["key"])).alias("f"))


def _shard(n: int) -> Column:
    return F.pmod(F.shiftright("h", 17), F.lit(n)).cast("int").alias("shard")


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the first column, then the next, and where each group of equal rows starts in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of a batch of `hashed_lines`: h, f, owner and n, the number of the batch's documents that have it."""
    for b in batches:
        if not b.num_rows:
            continue
        h, f = _numbers(b.column(2).flatten()), _numbers(b.column(3).flatten())
        row = np.repeat(np.arange(b.num_rows), _numbers(b.column(2).value_lengths()))
        order, starts = _groups(h, f, row)  # a document counts once
        order = order[starts]
        again, starts = _groups(h[order], f[order])
        order = order[again]
        doc = _numbers(b.column(0))[row[order]]
        owner, n = np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(order)))
        yield pa.RecordBatch.from_arrays([pa.array(h[order[starts]]), pa.array(f[order[starts]]), pa.array(owner), pa.array(n.astype(np.int64))], ["h", "f", "owner", "n"])


_INDEX = "shard int, n_keys long, levels binary, prints binary, owners binary, counts binary"
_KINDS = ("prints", np.int32), ("owners", np.int64), ("counts", np.int32)


def build_index(hashed: DataFrame, n_shards: int) -> DataFrame:
    """The index table, one row per shard, over all lines of `hashed`; a shard without lines has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def done() -> pa.RecordBatch:
            h, f, owner, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order, starts = _groups(h, f)
            owner, n = np.minimum.reduceat(owner[order], starts), np.add.reduceat(n[order], starts)
            h, f = h[order[starts]].view(np.uint64), f[order[starts]]
            first = np.concatenate([[True], h[1:] != h[:-1]])  # lines with one hash share a slot's place: the rest follow in `spare`
            found = PerfectHash.over(h[first])
            slots = np.empty(first.sum(), np.int64)
            slots[found.slots(h[first])] = np.flatnonzero(first)
            rest = np.flatnonzero(~first)
            order = np.concatenate([slots, rest])
            spare = np.concatenate([np.array([len(rest)], np.uint64), h[rest]]).tobytes()
            arrays = [x[order].astype(kind).tobytes() for x, (_, kind) in zip((f, owner, np.minimum(n, 2**31 - 1)), _KINDS)]
            columns = [[shard], [len(order)], [len(spare).to_bytes(8, "little") + spare + found.packed()], *([x] for x in arrays)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64()] + [pa.binary()] * 4)], ["shard", "n_keys", "levels", "prints", "owners", "counts"])

        for b in batches:
            s, columns = _numbers(b.column(0)), [_numbers(b.column(i)) for i in range(1, 5)]
            for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
                if not len(part):
                    continue
                if s[part[0]] != shard:
                    if parts:
                        yield done()
                    shard, parts = int(s[part[0]]), []
                parts.append([c[part] for c in columns])
        if parts:
            yield done()

    rows = hashed.select("doc_id", "row", "h", "f").mapInArrow(_combined, "h long, f int, owner long, n long").select(_shard(n_shards), "h", "f", "owner", "n")
    return written(rows.repartition(min(n_shards, table_partitions(hashed.sparkSession)), "shard").sortWithinPartitions("shard").mapInArrow(run, _INDEX), "index")


class Shard:
    """One row of the index, ready to be probed."""

    def __init__(self, levels: bytes, *arrays: bytes):
        n = int.from_bytes(levels[:8], "little")
        self.spare = np.frombuffer(levels[16 : 8 + n], np.uint64)
        self.hash = PerfectHash.unpacked(levels[8 + n :])
        for (name, kind), x in zip(_KINDS, arrays):
            setattr(self, name, np.frombuffer(x, kind))

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line, whether it is in the index, and its slot."""
        slot = self.hash.slots(h.view(np.uint64))
        hit = (slot >= 0) & (self.prints[slot] == f)
        base = len(self.prints) - len(self.spare)
        for i in range(len(self.spare)):  # two keys with one 64-bit hash: as good as never
            other = (h.view(np.uint64) == self.spare[i]) & (self.prints[base + i] == f)
            slot, hit = np.where(other, base + i, slot), hit | other
        return hit, slot

    def gone(self, doc: np.ndarray, h: np.ndarray, f: np.ndarray, least: int) -> np.ndarray:
        """Of each line of a document, whether at least `least` documents have it and another one owns it."""
        hit, slot = self.probe(h, f)
        hit[hit] = (self.counts[slot[hit]] >= least) & (self.owners[slot[hit]] != doc[hit])
        return hit


def probe(hashed: DataFrame, index: DataFrame, n_shards: int, least: int = 2, task_lines: int = TASK_LINES) -> DataFrame:
    """doc_id, row and place of every line that goes."""
    lines = hashed.select("doc_id", "row", F.explode(F.arrays_zip("place", "h", "f")).alias("x")).select("doc_id", "row", "x.place", "x.h", "x.f")
    loads = written(lines.groupBy(_shard(n_shards)).agg(F.ceil(F.count("*") / task_lines).cast("int").alias("ways")), "loads")
    loads = F.broadcast(loads) if n_shards < 10_000 else loads
    arrays = ["levels", *(name for name, _ in _KINDS)]
    own = {"doc_id": "bigint", "row": "bigint", "place": "int", "h": "bigint", "f": "int"}
    rows = index.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), *(F.lit(None).cast(kind).alias(c) for c, kind in own.items()), *arrays)
    sent = lines.select(_shard(n_shards), *own).join(loads, "shard")
    sent = sent.select("shard", F.pmod(F.xxhash64("doc_id", "row"), F.col("ways")).cast("int").alias("way"), *own, *(F.lit(None).cast("binary").alias(c) for c in arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for b in batches:
            where = _numbers(b.column(0)).astype(np.int64) << 32 | _numbers(b.column(1))
            loaded = np.flatnonzero(_numbers(b.column(7).is_valid()))
            cuts = np.unique(np.concatenate([[0], loaded, loaded + 1, np.flatnonzero(np.diff(where)) + 1, [len(where)]]))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if b.column(7)[i].is_valid:
                    at, arrays = where[i], Shard(*(b.column(c)[i].as_py() for c in range(7, 11)))
                elif where[i] == at:
                    part = b.slice(i, j - i)
                    doc, h, f = (_numbers(part.column(c)) for c in (2, 5, 6))
                    gone = pa.array(arrays.gone(doc.astype(np.int64), h.astype(np.int64), f.astype(np.int32), least))
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(gone) for c in (2, 3, 4)], ["doc_id", "row", "place"])

    both = rows.unionByName(sent).repartition("shard", "way").sortWithinPartitions("shard", "way", F.col("doc_id").asc_nulls_first())
    return both.mapInArrow(run, "doc_id long, row long, place int")


def deduplicated(docs: DataFrame, shortest: int = 10, least: int = 2, counts: bool = True, shard_lines: int = SHARD_LINES, task_lines: int | None = None) -> DataFrame:
    """The rows of `docs` without the lines that at least `least` documents have and another one owns; with `counts`, n_lines and n_dropped too.

    A text all of whose lines go becomes empty.
    """
    hashed = written(hashed_lines(docs.select("doc_id", "text"), shortest), "lines")
    lines, tasks = hashed.agg(F.sum(F.size("h"))).first()[0] or 0, table_partitions(docs.sparkSession)
    n = max(2 * tasks, -(-lines // shard_lines))
    task_lines = task_lines or min(TASK_LINES, max(2000, lines // tasks))  # a task's even share, where that is less
    gone = probe(hashed, build_index(hashed, n), n, least, task_lines).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("place")).alias("_gone")).withColumnsRenamed({"doc_id": "_id", "row": "_of"})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    rows = rows.join(gone, (F.col("_row.doc_id") == F.col("_id")) & (_row(F.col("_row.text")) == F.col("_of")), "left")
    rows = rows.select("_row", F.split(F.coalesce("_row.text", F.lit("")), "\n").alias("_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    # What lies between the places: from after each one (and the start) up to the next one (and the end).
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size("_lines"))), lambda a, b: F.slice("_lines", a + 2, b - a - 1))
    text = F.when(F.size("_gone") == 0, F.col("_row.text")).otherwise(F.array_join(F.flatten(between), "\n"))
    added = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_gone").cast("long")} if counts else {}
    kept = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in added]
    return rows.select(*kept, *(x.alias(c) for c, x in added.items()))


def op6_line_dedup(spark, sf_dir):
    from .common import documents

    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, o.owner IS NOT NULL AND o.owner <> doc_id AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
