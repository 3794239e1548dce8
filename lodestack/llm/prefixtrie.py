"""Trie of conversation prefixes: every distinct beginning of a conversation is a node, with what its subtree shares.

A turn's id is the MD5 of its role and text, in two whole numbers. Ids stand in eight columns by position, and one GROUP BY with
ROLLUP over them and `grouping_id` aggregates all prefixes of up to eight turns together. A longer conversation goes on in further
rows of eight columns: there the grouping also has the node that the block before ended in, so the blocks of conversations of
any length are grouped by the same statement, and nothing is done turn by turn. A node's key is its depth and the exclusive-or
of hashes of (position, turn id) along its path, 128 bits, so a block knows the node before it from a running exclusive-or, and
a node its parent by taking the last turn out.

Sums over subtrees come without walking the tree. Each node belongs to its smallest member; a conversation owns the nodes at the end
of its path, from some depth on. The first ROLLUP finds the owners. The second adds up over members: bytes from the node on
(every member's), bytes of owned nodes (each distinct node's once, as all members but the smallest own nothing above the
node), and owned nodes without children, which are the leaves. A node's saving is the first sum less the second.

Turns are numbered by `running_sums`, whose ranges split a very long conversation; ids and lengths alone are shuffled, never texts. Members
that end in a node are sorted by ranges and joined to pieces of text within tasks, and the pieces are hashed in order as a
stream, so a node where very many conversations end takes no more memory.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; turns that tie in `turn` follow the
MD5 of role and text; repeated rows are turns of their own; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ids import dense_ids
from .common import table, table_partitions, written

WIDTH = 8
#: Members in one piece of text.
PIECE = 10_000
_SEEDS = (11, 12)
_NODE = ["depth", "k1", "k2"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, r1, r2 (the halves of the MD5 of role and text) and n_bytes of the text, of each row with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(F.col("md5"), at, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("md5"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.select("conv_id", "turn", half(1).alias("r1"), half(16).alias("r2"), "n_bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), r1, r2 and n_bytes of the rebuilt conversations; one row with null position each besides.

    Conversation c begins with the first h turns of c - c % 5, h being the CRC-32 of c modulo 9, and goes on with its own after its first h.
    """
    placed = dense_ids(turns, ["conv_id", "turn", "r1", "r2"], "at").drop("turn")
    convs = placed.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    asked = convs.select("conv_id", "first", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    spec = written(asked.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("led", F.least(F.coalesce("base_n", F.lit(0)), "h")), "conversations")
    own = placed.join(spec, "conv_id").where(F.col("at") - F.col("first") >= F.col("h"))
    own = own.select("conv_id", (F.col("led") + F.col("at") - F.col("first") - F.col("h")).alias("position"), "r1", "r2", "n_bytes")
    heads = placed.where("conv_id % 5 = 0").join(spec.select("conv_id", "first"), "conv_id").where(F.col("at") - F.col("first") < 8)
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("at") - F.col("first")).alias("position"), "r1", "r2", "n_bytes")
    led = spec.select("conv_id", "base", "h").join(heads, "base").where("position < h").select("conv_id", "position", "r1", "r2", "n_bytes")
    none = F.lit(None).cast("long")
    empty = spec.select("conv_id", none.alias("position"), none.alias("r1"), none.alias("r2"), none.alias("n_bytes"))
    return own.unionByName(led).unionByName(empty)


def _hashed(depth: Column, turn: Column, seed: int) -> Column:
    return F.xxhash64(depth.cast("long"), turn["r1"], turn["r2"], F.lit(seed))


def _xor(parts: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for p in parts:
        out = out.bitwiseXOR(p)
    return out


def blocks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of `width` turns of a conversation (structs t1, t2, and so on, null after its end).

    Further: block (from 0), p1 and p2 (key of the node before), before (bytes of the turns before), rest (bytes from here on) and
    x1, x2 (what this block's turns add to the key), size (its turns). Each conversation has its block 0.
    """
    dealt = rows.withColumn("block", F.coalesce(F.floor(F.col("position") / width), F.lit(0)).cast("long")).repartition("conv_id", "block")
    of = lambda c, j: F.max(F.when(F.col("position") % width == j, F.col(c))).alias(f"{c}_{j + 1}")
    packed = dealt.groupBy("conv_id", "block").agg(F.count("position").alias("size"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), *(of(c, j) for j in range(width) for c in ("r1", "r2", "n_bytes")))
    turn = lambda j: F.when(F.col(f"n_bytes_{j}").isNotNull(), F.struct(*(F.col(f"{c}_{j}").alias(c) for c in ("r1", "r2", "n_bytes")))).alias(f"t{j}")
    out = packed.select("conv_id", "block", "size", "bytes", *(turn(j) for j in range(1, width + 1)))
    here = lambda s: _xor([F.when(F.col(f"t{j}").isNotNull(), _hashed(F.col("block") * width + j, F.col(f"t{j}"), s)).otherwise(0) for j in range(1, width + 1)])
    out = out.withColumns({"x1": here(_SEEDS[0]), "x2": here(_SEEDS[1])})
    whole = Window.partitionBy("conv_id").orderBy("block")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    started = {p: F.coalesce(F.expr(f"bit_xor({x})").over(earlier), F.lit(0)) for p, x in (("p1", "x1"), ("p2", "x2"))}
    return out.withColumns(started | {"before": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)), "rest": F.sum("bytes").over(after)}).drop("bytes")


def prefixes(rows: DataFrame, aggregates: dict[str, str], width: int = WIDTH) -> DataFrame:
    """The nodes: depth, key, key of the parent (q1, q2), n_bytes of the last text, path (bytes of the texts before it), inside (those of this block), `aggregates`.

    One ROLLUP over the turn columns; `aggregates` are SQL expressions over the members' blocks.
    """
    turns = ", ".join(f"t{j}" for j in range(1, width + 1))
    chosen = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    rolled = rows.sparkSession.sql(f"SELECT block, p1, p2, {turns}, max(before) AS before, {width} - bit_count(grouping_id()) AS level, {chosen} FROM {{rows}} GROUP BY block, p1, p2, ROLLUP ({turns})", rows=rows)
    # A level that a conversation does not reach has no turn; level 0 of a later block is the last level of the one before it.
    there = (F.col("level") > 0) & F.element_at(F.array(*(F.col(f"t{j}").isNotNull() for j in range(1, width + 1))), F.greatest("level", F.lit(1)))
    rolled = rolled.where(((F.col("level") == 0) & (F.col("block") == 0)) | there)
    along = lambda s, last: _xor([F.col(f"p{s + 1}"), *(F.when((F.col("level") >= j + (not last)), _hashed(F.col("block") * width + j, F.col(f"t{j}"), _SEEDS[s])).otherwise(0) for j in range(1, width + 1))])
    size = lambda j, when: F.when(when, F.col(f"t{j}.n_bytes")).otherwise(0)
    inside = sum((size(j, F.col("level") > j) for j in range(1, width + 1)), F.lit(0))
    last = sum((size(j, F.col("level") == j) for j in range(1, width + 1)), F.lit(0))
    out = rolled.select((F.col("block") * width + F.col("level")).alias("depth"), along(0, True).alias("k1"), along(1, True).alias("k2"), along(0, False).alias("q1"), along(1, False).alias("q2"), last.alias("n_bytes"), (F.col("before") + inside).alias("path"), inside.alias("inside"), *aggregates)
    return out


def ends_hashed(ends: DataFrame) -> DataFrame:
    """Node key and ends_sha256: SHA-256 of the conv_ids of `ends` (node key, conv_id), ascending and joined by commas."""

    def runs(columns: list[np.ndarray]) -> list[tuple[int, int]]:
        new = np.zeros(max(len(columns[0]) - 1, 0), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
        return list(zip(cuts[:-1], cuts[1:]))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            *node, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            out = [(*(n[i] for n in node), ids[k], ",".join(map(str, ids[k : min(k + PIECE, j)].tolist()))) for i, j in runs(node) for k in range(i, j, PIECE)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in out], pa.int64()) for c in range(4)), pa.array([r[4] for r in out], pa.string())], [*_NODE, "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([d[0][c] for d in done], pa.int64()) for c in range(3)]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string())], [*_NODE, "ends_sha256"])
            done.clear()
            return batch

        for b in batches:
            for d, k1, k2, piece in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if (d, k1, k2) != at:
                    if sha:
                        done.append((at, sha.hexdigest()))
                    at, sha = (d, k1, k2), hashlib.sha256(piece.encode())
                else:
                    sha.update(f",{piece}".encode())
            yield out()
        if sha:
            done.append((at, sha.hexdigest()))
        yield out()

    parts = table_partitions(ends.sparkSession)
    dealt = ends.select(*_NODE, "conv_id").repartitionByRange(parts, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    joined = dealt.mapInArrow(pieces, "depth long, k1 long, k2 long, first long, piece string")
    return joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the module's text for how each column comes about."""
    rows = written(blocks(rebuilt(turn_ids(conversations))), "blocks")
    nodes = written(prefixes(rows, {"owner": "min(conv_id)"}).drop("path", "inside"), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    owned = nodes.join(children, _NODE, "left").groupBy(F.col("owner").alias("conv_id")).agg(F.sum("n_bytes").alias("owned"), F.count(F.when(F.col("n_children").isNull(), 1)).alias("leaf"))
    known = rows.join(owned, "conv_id", "left").withColumns({"owned": F.coalesce("owned", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))})
    known = known.withColumn("shared", F.col("before") + F.col("rest") - F.col("owned"))  # bytes before the nodes that it owns
    sums = prefixes(known, {"conv_id": "min(conv_id)", "n_convs": "count(*)", "tail": "sum(rest)", "distinct_bytes": "sum(owned)", "n_leaves": "sum(leaf)", "shared": "min_by(shared, conv_id)"})
    total = F.col("tail") - F.col("n_convs") * F.col("inside")
    once = F.col("distinct_bytes") - (F.col("path") - F.col("shared"))
    sums = sums.withColumn("saved_tokens", total - once)
    ends = rows.groupBy("conv_id").agg(F.sum("size").alias("depth"), F.expr("bit_xor(x1)").alias("k1"), F.expr("bit_xor(x2)").alias("k2"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("owner").alias("parent_conv_id"))
    out = sums.join(children, _NODE, "left").join(ends_hashed(ends), _NODE, "left").join(above, ["depth", "q1", "q2"], "left")
    kinds = ("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    return out.select(*kinds)


def op12_prefix_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_transform(range(8), lambda z: 0::BIGINT)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
OP12_SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
turns AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
          xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (SELECT c.conv_id, 0 AS part, pos, id, n_bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
          UNION ALL SELECT c.conv_id, 1, pos, id, n_bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h),
whole AS (SELECT c.conv_id, coalesce(list(p.id ORDER BY part, pos) FILTER (p.id IS NOT NULL), []) AS ids, coalesce(list(p.n_bytes ORDER BY part, pos) FILTER (p.id IS NOT NULL), []) AS sizes
          FROM convs c LEFT JOIN parts p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (SELECT conv_id, d AS depth, array_to_string(ids[:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(ids[:d - 1], '') END AS parent_key, coalesce(sizes[d], 0) AS n_bytes, d = len(ids) AS ends
            FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM whole)),
nodes AS (SELECT depth, key, any_value(parent_key) AS parent_key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY depth, key),
children AS (SELECT parent_key AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent_key),
whole_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.key = n.key),
above AS (SELECT n.depth, n.key, x.n_children, x.saved, unnest(range(n.depth + 1)) AS up FROM nodes n JOIN whole_nodes x ON x.depth = n.depth AND x.key = n.key),
sums AS (SELECT left(key, 32 * up) AS key, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM whole_nodes n JOIN sums s ON s.key = n.key AND s.depth = n.depth LEFT JOIN nodes p ON p.key = n.parent_key AND p.depth = n.depth - 1
"""
