"""Packing token sequences by shortest-pack-first over the length histogram.

Each text is encoded once, where it is read; a text longer than a sequence is cut into full pieces and a rest.
Pieces are counted per (task, length); the histogram over lengths, at most `room` rows, goes to the driver, where
lengths are placed longest first into the packs with the most space left, whole groups of equal packs at a time.
A piece's rank among its length is its rank in its task and the count of the tasks before; a search in the
pattern table turns rank into sequence and offset.

Defined cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed as often as they
come; ties in length are ordered by task and row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoded, vocabulary

ROOM = 4096
#: This job holds little else, so that its workers can keep more words (200 MB).
KEPT_WORDS = 1_000_000


def shortest_pack_first(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, packs, times, first sequence, offset): `packs` packs from `first sequence` on hold `times` pieces of
    `length` one after another from `offset`. The slots of a length, in this order, take up all its pieces."""
    groups: dict[int, list[tuple[int, object]]] = {}  # space left: [(packs, pattern)], a pattern being (its start, length, times)
    heap: list[int] = []

    def put(gap: int, packs: int, pattern: object) -> None:
        if gap not in groups:
            groups[gap] = []
            heapq.heappush(heap, -gap)
        groups[gap].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0] >= length:
            gap = -heap[0]
            packs, pattern = groups[gap].pop()
            alone = not groups[gap]
            if alone:
                heapq.heappop(heap)
                del groups[gap]
            next_gap = -heap[0] if heap else 0
            times = min(gap // length, max(1, -(-(gap - next_gap) // length))) if alone else 1
            if packs * times > left:
                times = max(1, left // packs)
            used = min(packs, left // times)
            if used < packs:
                put(gap, packs - used, pattern)
            put(gap - times * length, used, (pattern, length, times))
            left -= used * times
        if left:
            each = room // length
            if left // each:
                put(room - each * length, left // each, (None, length, each))
            if left % each:
                put(room - left % each * length, 1, (None, length, left % each))
    slots, first = [], 0
    for gap in sorted(groups):
        for packs, pattern in groups[gap]:
            chain = []
            while pattern:
                pattern, length, times = pattern
                chain.append((length, times))
            offset = 0
            for length, times in reversed(chain):
                slots.append((length, packs, times, first, offset))
                offset += length * times
            first += packs
    return sorted(slots)


def pieces(docs: DataFrame, path: str, drops_space: bool = True, room: int = ROOM) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; part and nth: its rank among its length in its task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for b in batches:
            rows = []
            for i, ids in encoded(b.column(1), path, drops_space, KEPT_WORDS):
                for at in range(0, len(ids), 4 * room):
                    piece = ids[at : at + 4 * room]
                    rows.append((i, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, part, int(seen[len(piece) // 4])))
                    seen[len(piece) // 4] += 1
            if rows:
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in rest)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def packed(docs: DataFrame, path: str | None = None, drops_space: bool = True, room: int = ROOM) -> DataFrame:
    """Every piece of `docs` (doc_id, text) with its sequence_id and its offset there."""
    cut = written(pieces(docs, path or vocabulary("word_bpe_49k.json"), drops_space, room), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = shortest_pack_first(histogram, room)
    table = np.array(slots, np.int64).reshape(-1, 5)
    takes = table[:, 1] * table[:, 2]
    before = np.concatenate([[0], np.cumsum(takes)])[:-1]
    opens = np.flatnonzero(np.diff(table[:, 0], prepend=-1))
    before = before - np.repeat(before[opens], np.diff(np.append(opens, len(table))))
    shift = 40  # ranks below 2**40
    keys = table[:, 0] << shift | before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, length << shift | rank, "right") - 1
            nth, times = rank - before[at], table[at, 2]
            new = [pa.array(table[at, 3] + nth // times), pa.array(table[at, 4] + nth % times * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *new], [*b.schema.names[:-1], "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    # Tasks times lengths rows: never one to broadcast, so it is merged by key.
    ranked = cut.join(ranks.hint("merge"), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("earlier") + F.col("nth")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark, sf_dir):
    from .common import documents

    return packed(documents(spark, sf_dir))
