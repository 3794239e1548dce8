"""Exact nearest rows of a query table, by blocks of matrix products, and the running best of whatever a task scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import blocks, from_block
from ..session import discard, written

#: Entries that a task keeps: 24 bytes each, and as many again that are new.
HELD = 2_000_000
#: Up to here the best of all queries that are small enough to be broadcast fit in a task.
SMALL_K = 256
#: Queries that one task takes past its vectors, block by block, when k is larger.
QUERIES_A_TASK = 65_536
#: Entries that are merged at once then, about; a merge takes some hundred bytes for each.
MERGED = 200_000
FOUND = "query_id long, passage_id long, score double"


def ranked(rows: DataFrame, k: Column | int, by: str = "query_id", score: str = "score", key: str = "passage_id") -> DataFrame:
    """The best k rows of each query with their rank from 1; ties go to the least key."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """The best k of each query over all that a task has scored; least ids first among equal scores, which are rounded to nine places.

    New scores must reach a query's k-th best to be kept, and are merged when they are as many as what is held. `add` gives what
    must be sent on when more queries come by than `held` entries suffice for; the final cut sees to what was sent twice over.
    With `distinct`, an id that comes more than once counts once, by its best score.
    """

    def __init__(self, k: int, held: int = HELD, distinct: bool = False):
        self.k, self.most, self.distinct = k, held, distinct
        self._reset()

    def _reset(self) -> None:
        self.names: dict[int, int] = {}
        self.bar, self.limit = np.zeros(0), np.zeros(0, np.int64)
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query's number, score, id
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_fresh = 0

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, limits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """`score` has a row for each query and a column for each id; a query may have a limit of its own below k."""
        if not score.size:
            return
        score = np.round(score, 9)
        at = np.array([self.names.setdefault(q, len(self.names)) for q in queries.tolist()])
        if len(self.names) > len(self.bar):
            more = max(len(self.names), len(self.bar))
            self.bar, self.limit = np.concatenate([self.bar, np.full(more, -np.inf)]), np.concatenate([self.limit, np.full(more, self.k)])
        if limits is not None:
            self.limit[at] = np.minimum(limits, self.k)
        bar, m, most = self.bar[at], score.shape[1], self.limit[at]
        for k in np.unique(most[most < m]).tolist():
            of = most == k
            bar[of] = np.maximum(bar[of], np.partition(score[of], m - k, axis=1)[:, m - k] if k else np.inf)
        row, column = np.nonzero(score >= bar[:, None])
        self.fresh.append((at[row], score[row, column], ids[column]))
        self.n_fresh += len(row)
        if self.n_fresh > max(len(self.kept[0]), self.most // 4):
            self._merge()
            if len(self.kept[0]) > self.most:
                yield self.out()

    def _merge(self) -> None:
        row, score, ids = (np.concatenate([self.kept[c], *(f[c] for f in self.fresh)]) for c in range(3))
        order = np.lexsort((ids, -score, row))
        if self.distinct:
            by_id = np.lexsort((-score, ids, row))
            again = (np.diff(row[by_id], prepend=-1) == 0) & (np.diff(ids[by_id], prepend=-1) == 0)
            order = order[~again[np.argsort(by_id)][order]]
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        limit = self.limit[row]
        keep = place < limit
        self.kept = row[keep], score[order][keep], ids[order][keep]
        last = place[keep] == limit[keep] - 1
        self.bar[self.kept[0][last]] = self.kept[1][last]
        self.fresh, self.n_fresh = [], 0

    def out(self) -> pa.RecordBatch:
        """What is held; afterwards nothing is."""
        self._merge()
        names = np.fromiter(self.names, np.int64, len(self.names))
        batch = pa.RecordBatch.from_arrays([pa.array(names[self.kept[0]]), pa.array(self.kept[2]), pa.array(self.kept[1])], ["query_id", "passage_id", "score"])
        self._reset()
        return batch


def scored(batches: Iterator[pa.RecordBatch], k: int, metric: str, outer: bool) -> Iterator[pa.RecordBatch]:
    """The task's best, from batches of pairs of a block of queries (ids, dim, vectors, limits) and one of vectors (ids, dim, vectors).

    With `outer`, blocks of queries come one after another, each with all of the task's vectors, and `MERGED` entries at most are merged at once.
    """
    bests: dict[int, Best] = {}
    at = None

    def out() -> Iterator[pa.RecordBatch]:
        for best in bests.values():
            yield best.out()
        bests.clear()

    def met(b: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        nonlocal at
        q_ids, q = from_block(b.column(0)[i], b.column(1)[i].as_py(), b.column(2)[i].as_py())
        ids, x = from_block(b.column(4)[i], b.column(5)[i].as_py(), b.column(6)[i].as_py())
        limits = b.column(3)[i].values.to_numpy(zero_copy_only=False)
        if outer and at is not None and q_ids.tobytes() != at:
            yield from out()  # these queries do not come by again
        at = q_ids.tobytes() if outer else None
        step = max(1, MERGED // (2 * k)) if outer else max(1, len(q_ids))
        for j in range(0, len(q_ids), step):
            part = q[j : j + step]
            score = part @ x.T
            if metric == "l2":
                score = 0.0 - np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * score, 0))
            if j not in bests:
                bests[j] = Best(k, max(MERGED, k) if outer else HELD)
            yield from bests[j].add(q_ids[j : j + step], score, ids, limits[j : j + step])

    for b in batches:
        for i in range(b.num_rows):
            yield from met(b, i)
        del b  # before the next batch is read
    yield from out()


def task_best(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", query_key: str = "query_id", query_vector: str = "qvec", key: str = "passage_id", vector: str = "embedding", query_block: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, passage_id and score of each task's best: at most k rows for each query and task, or as many as a query's own `fetch_k` says, if that is less."""
    limit = F.coalesce(F.col("fetch_k"), F.lit(k)) if "fetch_k" in queries.columns else F.lit(k)
    queries = queries.select(query_key, query_vector, limit.alias("_limit"))
    outer = k > SMALL_K
    if outer:  # a block of queries meets all of a task's vectors before the next one does
        once = written(queries, "queries")
        tasks = -(-max(1, once.count()) // QUERIES_A_TASK)
        queries = once.repartition(tasks)
        query_block = min(query_block, max(16, HELD // (2 * k)))
    q = blocks(queries, query_key, query_vector, query_block, F.col("_limit")).select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "dim", "vectors", "numbers")))
    if outer:  # every task that scores reads them, and would need another Python for that as long as it runs
        q = written(q, "blocks").coalesce(tasks)
        discard(once)
    met = (q.hint("shuffle_replicate_nl") if outer else q).crossJoin(blocks(corpus, key, vector, block))
    return met.mapInArrow(lambda batches: scored(batches, k, metric, outer), FOUND)


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "ip", **how) -> DataFrame:
    """query_id, passage_id, score and rank of the k best by inner product ("ip") or negative distance ("l2"). `how` goes to `task_best`.

    Every block of queries meets every block of vectors once. A task keeps the best of what it has met, so k rows for each query and
    task are shuffled at most, whatever k is. Memory is two blocks, their products and `HELD` entries,
    and what merging takes: as much again for a small k, `MERGED` entries at a time for a large one.
    """
    return ranked(task_best(queries, corpus, k, metric, **how).withColumn("score", F.round("score", 9)), k)
