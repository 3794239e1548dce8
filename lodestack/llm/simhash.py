"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Texts within 3 bits of each other are linked. Half the radius is one bit, and the odd bit is taken up by a block
of the fingerprint that is left out: the 64 bits are cut into `blocks`, each block is left out in turn, and every
distinct fingerprint emits all variants of the rest within one bit (about 131 rows for three blocks, where full
balls of two bits would need 2,081). Two fingerprints 3 bits apart differ in some block, and without it they are
at most two bits apart, so they meet in a variant. Variants are shuffled, and each bucket's fingerprints are
compared exactly; a bucket gives a spanning forest of its links, never all pairs. A bucket of more than
`dense_limit` fingerprints is not compared: its members emit full balls of one bit and of two bits, and whoever
meets is linked by the triangle rule alone, so that no fingerprint or link is left out.

Exact copies share a fingerprint and are one row from the first aggregation on.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; fewer than three words
make one shingle; repeated rows fall together; a null doc_id is carried, and is the component's id only where
nothing else is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

SEED = 42
RADIUS = 3


def fingerprint(text: bytes | None, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text's 3-word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < 3:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-3] + 1])
    n = len(starts)
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[2:].tolist())), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and fp, the fingerprint's 64 bits as a signed long."""
    picked = docs.select(key, F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return picked.mapInArrow(run, f"`{key}` {picked.schema[0].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    """All masks of at most `most` (0 to 2) of these bits."""
    out = [0] + [1 << i for i in bits] * (most > 0)
    if most > 1:
        out += [1 << i | 1 << j for n, i in enumerate(bits) for j in bits[:n]]
    return [_signed(x) for x in out]


def _flipped(fp: Column, bits: list[int], most: int, tag: int = 0) -> Column:
    kept = _signed(sum(1 << i for i in bits))
    return F.transform(F.array(*map(F.lit, _flips(bits, most))), lambda m: fp.bitwiseAND(F.lit(kept)).bitwiseXOR(m).bitwiseXOR(F.lit(_signed(tag))))


def _variants(fp: Column, blocks: int) -> Column:
    """Keys of all balls: for each left-out block, the rest within one bit; a block's own bits hold its number."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return F.concat(*(_flipped(fp, [i for i in range(64) if not a <= i < b], 1, (n + 1) << a) for n, (a, b) in enumerate(zip(edges, edges[1:]))))


def _rooted(x: np.ndarray, radius: int) -> np.ndarray:
    """x: buckets by members. Index of the least member that each one reaches inside its bucket."""
    m = x.shape[1]
    far = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) > radius
    root = np.broadcast_to(np.arange(m), x.shape).copy()
    while True:
        new = np.where(far, m, root[:, None, :]).min(axis=2)
        if (new == root).all():
            return root
        root = new


def _bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Links (n, 2) inside whole buckets: each member with the least one that it reaches there."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    out = []
    for m in np.unique(sizes[sizes > 1]):
        at = starts[sizes == m]
        step = max(1, (1 << 21) // int(m) ** 2)
        for i in range(0, len(at), step):
            x = fps[at[i : i + step, None] + np.arange(m)]
            root = np.take_along_axis(x, _rooted(x, radius), axis=1)
            moved = root != x
            out.append(np.stack([x[moved], root[moved]], axis=1))
    links = np.concatenate(out) if out else np.empty((0, 2), np.uint64)
    return np.unique(links, axis=0) if len(links) else links


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = 3, dense_limit: int = 512) -> DataFrame:
    """Pairs (a, b) whose closure joins exactly the fingerprints `fp` within `radius` (3 or less) of one another."""
    keys = distinct.select("fp", F.explode(_variants(F.col("fp"), blocks)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: np.ndarray, dense: bool) -> pa.RecordBatch:
            x = np.ascontiguousarray(pairs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.full(len(x), dense))], ["a", "b", "dense"])

        held_k, held_f, dense_key = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            k = np.concatenate([held_k, batch.column(1).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(k):
                continue
            if dense_key is not None:
                cut = np.searchsorted(k, dense_key, "right")
                if cut:
                    yield out(np.stack([f[:cut], f[:cut]], axis=1), True)
                k, f = k[cut:], f[cut:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                dense_key = None
            cut = np.searchsorted(k, k[-1], "left")
            yield out(_whole(k[:cut], f[:cut]), False)
            held_k, held_f = k[cut:], f[cut:]
            if len(held_k) > dense_limit:
                yield out(np.stack([held_f, held_f], axis=1), True)
                dense_key, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
            crowded = _crowded(k[:cut], dense_limit)
            if crowded.any():
                yield out(np.stack([f[:cut][crowded]] * 2, axis=1), True)
        if len(held_k):
            yield out(_whole(held_k, held_f), False)

    def _crowded(k: np.ndarray, most: int) -> np.ndarray:
        if not len(k):
            return np.zeros(0, bool)
        _, index, n = np.unique(k, return_inverse=True, return_counts=True)
        return n[index] > most

    def _whole(k: np.ndarray, f: np.ndarray) -> np.ndarray:
        few = ~_crowded(k, dense_limit)
        return _bucket_links(k[few], f[few], radius) if few.any() else np.empty((0, 2), np.uint64)

    found = written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, dense boolean").distinct(), "found")
    near = found.where("not dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    if dense.isEmpty():
        return near
    every = list(range(64))
    small = dense.select("fp", F.explode(_flipped(F.col("fp"), every, radius // 2)).alias("key")).groupBy("key").agg(F.min("fp").alias("b"))
    large = dense.select(F.col("fp").alias("a"), F.explode(_flipped(F.col("fp"), every, radius - radius // 2)).alias("key"))
    return near.unionByName(large.join(small, "key").where("a <> b").select("a", "b").distinct())


#: Rows of one fingerprint from which on it is joined by broadcast; there are at most rows / HOT_ROWS such fingerprints.
HOT_ROWS = 1_000_000


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", hot_rows: int = HOT_ROWS, **how) -> DataFrame:
    """`key`, fp and component_id: the least key reachable over links, itself included. One row per row of `docs`."""
    marked = written(fingerprints(docs, text, key), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    groups = components(links(least.select("fp"), **how))
    least = least.join(groups, least.fp == groups.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = written(least, "roots")
    owner = least.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(least.join(owner, "root").select("fp", "n", "component_id"), "named")
    # A fingerprint that a large part of all rows have would meet in one task.
    hot = named.where(F.col("n") > hot_rows).select("fp", F.col("component_id").alias("_hot"))
    rest = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(named.where(F.col("n") <= hot_rows), "fp")
    often = marked.join(F.broadcast(hot), "fp").withColumnRenamed("_hot", "component_id")
    return rest.select(key, "fp", "component_id").unionByName(often.select(key, "fp", "component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the least doc_id, null ids last.

    Rows are told apart by a written number, so that repeated and null ids leave one row too; columns may have any names.
    """
    marked = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.monotonically_increasing_id().alias("row")), "marked")
    key = F.struct(F.col("whole.doc_id").isNull().alias("no_id"), F.col("whole.doc_id").alias("id"), F.col("row"))
    near = near_duplicates(marked.select(key.alias("key"), F.col("whole.text").alias("text")), key="key")
    kept = near.where(F.col("key.row") == F.col("component_id.row")).select(F.col("key.row").alias("row"))
    return marked.join(kept, "row", "left_semi").select("whole.*")


def op7_simhash(spark, sf_dir):
    from .common import documents

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
