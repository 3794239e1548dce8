"""Inverted-file index with product quantisation: train on a sample, encode, append, probe and score.

Trained tables (centroids, rotation, codebooks) are bounded by their settings, not by the corpus, and travel with the task. They come
from k-means rounds over the sample where it lies: a task adds up its rows by cluster, Spark adds up the tasks' sums, and
one row per cluster reaches the driver. A sample of no more than `LOCAL_BYTES` is fitted in the driver instead, by the same steps.

A rotation turns what is left of a vector after its list's centroid, so that sub-spaces share it evenly: codes and rotation are
fitted in turn, the rotation from the product of residuals and their codes, which Spark adds up. Vectors may stand in several
lists (`border`), so that one near the border between lists is found from either side; results have it once.

Postings are blocks: (list_id, domain, passage_ids, codes), at most `BLOCK` entries a row, stored in one folder per batch and list.
A search reads the folders of probed lists alone, and a list's queries meet its blocks in batches, one set of matrix
operations each. A list that is much longer than others is just more rows. Vectors that are null are in no list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_matrix, with_vectors
from ..session import discard, written
from .topk import FOUND, Best, ranked

SEED, BLOCK, QUERY_BLOCK = 1234, 4096, 256
POSTINGS = "list_id int, domain string, passage_ids array<long>, codes binary"
#: Bytes of a sample that the driver may fit itself.
LOCAL_BYTES = 2 << 20
#: Files of a sample whose counts may go to every task.
BROADCAST_FILES = 100_000


@dataclass
class Quantiser:
    """Coarse centroids (lists by dim), codebooks (subs by codes by dim / subs) and a rotation of residuals; no codebooks: vectors are kept whole.

    A vector stands in its `border` best lists.
    """

    centroids: np.ndarray
    codebooks: np.ndarray | None = None
    rotation: np.ndarray | None = None
    border: int = 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(axis=1).astype(np.int32)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The `border` best lists of each row, best first."""
        most = min(self.border, len(self.centroids))
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :most].astype(np.int32) if most > 1 else self.assign(x)[:, None]

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        if self.codebooks is None:
            return np.ascontiguousarray(x, np.float32).view(np.uint8)
        subs, _, width = self.codebooks.shape
        rest = self.turned(x - self.centroids[lists]).reshape(len(x), subs, width)
        return np.stack([_nearest(rest[:, m], self.codebooks[m]) for m in range(subs)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals, still turned, that codes stand for."""
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], axis=1)

    def score(self, q: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Of queries (rows) and a list's entries (columns); sums of table look-ups, one table for each query and sub-space."""
        if self.codebooks is None:
            return q @ np.ascontiguousarray(codes).view(np.float32).astype(np.float64).T
        subs, _, width = self.codebooks.shape
        tables = np.einsum("mcw,qmw->mqc", self.codebooks, self.turned(q).reshape(len(q), subs, width))
        out = np.repeat((q @ self.centroids[list_id])[:, None], len(codes), axis=1)
        for m in range(subs):
            out += tables[m][:, codes[:, m]]
        return out

    @property
    def code_size(self) -> int:
        return 4 * self.centroids.shape[1] if self.codebooks is None else self.codebooks.shape[0]


def _mark(key: str, seed: int) -> Column:
    """40 bits of the MD5 of seed and key, which any engine can make."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 10), 16, 10).cast("long")


def sample(embeddings: DataFrame, size: int, file: str = "file_id", key: str = "passage_id", seed: int = SEED) -> DataFrame:
    """max(1, size // files) rows of each file by hash, no more than it has; of more files than `size`, that many by hash.

    So there are at most `size` rows in all, and they stay where they lie. A first cut by hash at twice a file's share, before anything is shuffled,
    keeps a file's rows from meeting in one task; a file where the cut leaves too few (which chance makes rare) gives fewer.
    """
    counts = embeddings.groupBy(file).agg(F.count("*").alias("_n"))
    files = counts.count()
    if files > size:
        counts = counts.orderBy(_mark(file, seed), file).limit(size)
    if files <= BROADCAST_FILES:
        counts = F.broadcast(counts)
    quota = max(1, size // max(1, files))
    share = F.least(F.lit(1.0), F.lit(2.0 * quota + 50) / F.col("_n"))
    near = embeddings.withColumn("_h", _mark(key, seed)).join(counts, file).where(F.col("_h") < share * float(1 << 40))
    picked = near.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy("_h", key))).where(F.col("_r") <= quota)
    return picked.drop("_h", "_r", "_n")


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of `c` to each row of `x`; |x| is the same for all and left out."""
    return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


#: Bytes of the tasks' sums that the driver may add up itself.
DRIVER_BYTES = 16 << 20


def _summed(rows: DataFrame | np.ndarray, step, clusters: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by cluster. `step` maps a matrix of vectors (first column of `rows`, or `rows` itself) to cluster numbers and what to add.

    Each task sends one row for each cluster that it has. Where these could be more than DRIVER_BYTES, a cluster's rows meet in one
    task again, and one row of it is collected.
    """

    def sums(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        n, total = np.zeros(clusters), np.zeros((clusters, width))
        for at, count, x in parts:
            n += np.bincount(at, count, clusters)
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(heads):
                total[at[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
        return n, total

    def add(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n, total = sums(parts)
        of = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(n[of]), pa.array(list(total[of]), pa.list_(pa.float64()))], ["cluster", "n", "total"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield add((at, np.ones(len(at)), x) for b in batches if b.num_rows for at, x in [step(as_matrix(b.column(0)).astype(np.float64))])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield add((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), as_matrix(b.column(2))) for b in batches if b.num_rows)

    if isinstance(rows, np.ndarray):
        at, x = step(rows)
        return sums(iter([(at, np.ones(len(at)), x)]))
    kinds = "cluster int, n double, total array<double>"
    n, total = np.zeros(clusters), np.zeros((clusters, width))
    parts = rows.mapInArrow(first, kinds)
    if rows.rdd.getNumPartitions() * clusters * (width + 2) * 8 > DRIVER_BYTES:
        parts = parts.repartition("cluster").mapInArrow(second, kinds)
    for r in sorted(parts.collect(), key=lambda r: (r.cluster, r.total)):  # in one order, so that reruns agree
        n[r.cluster] += r.n
        total[r.cluster] += r.total
    return n, total


def _coarse_round(rows: DataFrame | np.ndarray, centroids: np.ndarray, spherical: bool) -> np.ndarray:
    n, total = _summed(rows, lambda x: (Quantiser(centroids).assign(x), x), *centroids.shape)
    out = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)  # a list without rows stays where it is
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if spherical else out


def _fine_round(rows: DataFrame | np.ndarray, q: Quantiser) -> np.ndarray:
    """One round for the codebooks of all sub-spaces at once: a row adds its part of the residual to one code of each."""
    subs, codes, width = q.codebooks.shape

    def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = q.assign(x)
        at = q.encode(x, lists).astype(np.int64) + codes * np.arange(subs)
        return at.ravel(), q.turned(x - q.centroids[lists]).reshape(-1, width)

    n, total = _summed(rows, step, subs * codes, width)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], q.codebooks.reshape(-1, width)).reshape(subs, codes, width)


def _rotation(rows: DataFrame | np.ndarray, q: Quantiser) -> np.ndarray:
    """The rotation that brings residuals nearest to what their codes stand for: from the sum of residual times decoded, dim by dim."""
    dim = q.centroids.shape[1]

    def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = q.assign(x)
        return np.arange(dim), (x - q.centroids[lists]).T @ q.decode(q.encode(x, lists))

    _, product = _summed(rows, step, dim, dim)
    u, _, v = np.linalg.svd(product)
    return u @ v


def _balanced(rows: DataFrame | np.ndarray, q: Quantiser, subs: int) -> np.ndarray:
    """A rotation to start from: principal directions of the residuals, dealt to sub-spaces so that the products of their variances are even.

    The largest variance left goes to the sub-space with the smallest product so far that has room.
    """
    dim = q.centroids.shape[1]

    def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - q.centroids[q.assign(x)]
        return np.arange(dim), rest.T @ rest

    _, product = _summed(rows, step, dim, dim)
    values, axes = np.linalg.eigh(product)
    sizes, dealt = np.zeros(subs), [[] for _ in range(subs)]
    for i in np.argsort(-values, kind="stable"):
        m = min((m for m in range(subs) if len(dealt[m]) < dim // subs), key=lambda m: (sizes[m], m))
        dealt[m].append(i)
        sizes[m] += np.log(max(values[i] / max(1e-12 * values[-1], 1e-300), 1.0))
    return axes[:, [i for part in dealt for i in part]]


def _first_rows(sampled: DataFrame, vector: str, key: str, n: int, seed: int) -> np.ndarray:
    """At most n distinct vectors, the first ones by hashed key among 4 n rows."""
    rows = with_vectors(sampled, key, vector).select(F.xxhash64(key, F.lit(seed)).alias("h"), key, F.col(vector).alias("v")).orderBy("h", key).limit(4 * n).select(key, "v").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    x = as_matrix(rows.column("v").combine_chunks(), rows.column(key).combine_chunks()).astype(np.float64)
    return x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:n]]


def train(sampled: DataFrame, n_lists: int = 4096, subs: int | None = 16, bits: int = 8, rounds: int = 10, vector: str = "embedding", key: str = "passage_id", seed: int = SEED, turns: int = 0, border: int = 1) -> Quantiser:
    """Spherical k-means for the lists, then k-means of the residuals in all sub-spaces at once, in rounds over the sample.

    With `turns`, residuals are turned to their principal directions, and the rotation is fitted that often between the rounds. The driver holds what is trained; of the sample, no
    more than the rows that training starts from, four times as many, or all of it where that is at most `LOCAL_BYTES`. Fewer distinct
    vectors than lists give fewer lists. Vectors that are null count for nothing; vectors of unequal length are an error.
    """
    parts = int(sampled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(with_vectors(sampled, key, vector).repartition(parts, key), "sample")  # dealt evenly: a large file's rows come from one task of `sample`
    centroids = _first_rows(rows, vector, key, n_lists, seed)
    if not len(centroids):
        raise ValueError("no vectors to train on")
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    vectors = rows.select(vector)
    if rows.count() * centroids.shape[1] * 4 <= LOCAL_BYTES:
        held = rows.orderBy(key).select(vector).toArrow().column(0).combine_chunks()
        vectors = as_matrix(held).astype(np.float64)
    for _ in range(rounds):
        before, centroids = centroids, _coarse_round(vectors, centroids, True)
        if np.allclose(before, centroids, atol=1e-9):
            break
    if not subs:
        return Quantiser(centroids, border=border)
    if centroids.shape[1] % subs:
        raise ValueError(f"{centroids.shape[1]} dimensions do not divide by {subs}")
    codes, width = 1 << bits, centroids.shape[1] // subs
    start = _first_rows(rows, vector, key, codes, seed + 1)
    q = Quantiser(centroids, border=border)
    if turns:
        q = replace(q, rotation=_balanced(vectors, q, subs))
    start = q.turned(start - centroids[q.assign(start)]).reshape(len(start), subs, width).transpose(1, 0, 2)
    q = replace(q, codebooks=np.concatenate([start, np.repeat(start[:, :1], codes - start.shape[1], axis=1)], axis=1))
    for i in range(rounds):
        before, q = q, replace(q, codebooks=_fine_round(vectors, q))
        if i < turns:
            q = replace(q, rotation=_rotation(vectors, q))
        elif np.allclose(before.codebooks, q.codebooks, atol=1e-9):
            break
    discard(rows)
    return q


def save(q: Quantiser, spark: SparkSession, path: str, encoder: str = "hashed") -> None:
    """centroids, codebooks, rotation (no rows: none) and a one-row index_meta that names the encoder."""
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(q.centroids)], "list_id int, centroid array<double>").write.parquet(f"{path}/centroids")
    words = [] if q.codebooks is None else [(m, c, w.tolist()) for m, book in enumerate(q.codebooks) for c, w in enumerate(book)]
    spark.createDataFrame(words, "sub int, code int, word array<double>").write.parquet(f"{path}/codebooks")
    turned = [] if q.rotation is None else [(i, r.tolist()) for i, r in enumerate(q.rotation)]
    spark.createDataFrame(turned, "dim int, row array<double>").write.parquet(f"{path}/rotation")
    meta = (encoder, len(q.centroids), q.centroids.shape[1], 0 if q.codebooks is None else len(q.codebooks), q.border)
    spark.createDataFrame([meta], "encoder string, n_lists int, dim int, subs int, border int").write.parquet(f"{path}/index_meta")


def load(spark: SparkSession, path: str, encoder: str | None = None) -> Quantiser:
    """Refuses an index of another encoder."""
    meta = spark.read.parquet(f"{path}/index_meta").first()
    if encoder and meta.encoder != encoder:
        raise ValueError(f"the index is of encoder {meta.encoder}, not {encoder}")
    centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()])
    words = np.array([r.word for r in spark.read.parquet(f"{path}/codebooks").orderBy("sub", "code").collect()])
    turned = np.array([r.row for r in spark.read.parquet(f"{path}/rotation").orderBy("dim").collect()])
    return Quantiser(centroids, words.reshape(meta.subs, -1, centroids.shape[1] // meta.subs) if meta.subs else None, turned if len(turned) else None, meta.border)


def assign(embeddings: DataFrame, q: Quantiser, key: str = "passage_id", vector: str = "embedding") -> DataFrame:
    """key and list_id (the best one) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q.assign(as_matrix(b.column(1), b.column(0)).astype(np.float64)))], [key, "list_id"])

    return with_vectors(embeddings, key, vector).mapInArrow(run, f"{key} long, list_id int")


_ENTRY = "list_id int, domain string, passage_id long, code binary"


def encode(embeddings: DataFrame, q: Quantiser, domain: str | None = None, key: str = "passage_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Posting blocks of all vectors. Codes are made where the vectors lie; codes alone are shuffled, by list."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column(1), b.column(0)).astype(np.float64)
                of = q.lists(x)
                row = pa.array(np.repeat(np.arange(len(x)), of.shape[1]))
                made = q.encode(np.repeat(x, of.shape[1], axis=0), of.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(of.ravel()), b.column(2).take(row), b.column(0).take(row), pa.array([r.tobytes() for r in made], pa.binary())], ["list_id", "domain", "passage_id", "code"])

    label = F.col(domain) if domain else F.lit(None)
    return packed(with_vectors(embeddings, key, vector, label.cast("string").alias("domain")).mapInArrow(codes, _ENTRY), q.code_size, block)


def entries(postings: DataFrame, code_size: int) -> DataFrame:
    """list_id, domain, passage_id and code of every live entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b.column(3)[i].as_py(), np.uint8).reshape(len(ids), code_size)
                live = alive(len(ids), b.column(4)[i])
                ids, codes = ids[live], codes[live]
                n = pa.array(np.full(len(ids), i))
                yield pa.RecordBatch.from_arrays([b.column(0).take(n), b.column(1).take(n), pa.array(ids), pa.array([r.tobytes() for r in codes], pa.binary())], ["list_id", "domain", "passage_id", "code"])

    return with_dead(postings).mapInArrow(run, _ENTRY)


def with_dead(postings: DataFrame) -> DataFrame:
    """The columns of POSTINGS and `dead`: the places in the block of entries that no longer count, or null."""
    dead = F.col("dead") if "dead" in postings.columns else F.lit(None).cast("array<int>").alias("dead")
    return postings.select("list_id", "domain", "passage_ids", "codes", dead)


def alive(n: int, dead: pa.Scalar) -> np.ndarray:
    out = np.ones(n, bool)
    if dead.is_valid:
        out[dead.values.to_numpy(zero_copy_only=False)] = False
    return out


def entry_ids(postings: DataFrame) -> DataFrame:
    """list_id, domain and passage_id of every live entry; codes are not read."""
    if "dead" not in postings.columns:
        return postings.select("list_id", "domain", F.explode("passage_ids").alias("passage_id"))
    rows = postings.select("list_id", "domain", "dead", F.posexplode("passage_ids").alias("_at", "passage_id"))
    return rows.where(F.col("dead").isNull() | ~F.array_contains("dead", F.col("_at"))).select("list_id", "domain", "passage_id")


def packed(rows: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """Posting blocks of entries (list_id, domain, passage_id, code of `size` bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], 0

        def out(most: int) -> Iterator[pa.RecordBatch]:
            ids, data = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            for i in range(0, most, block):
                part = ids[i : min(i + block, most)]
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.string()), pa.array([part], pa.list_(pa.int64())), pa.array([data[i : i + len(part)].tobytes()], pa.binary())], ["list_id", "domain", "passage_ids", "codes"])
            held[:] = [(ids[most:], data[most:])]

        for b in batches:
            if not b.num_rows:
                continue
            lists, names = b.column(0).to_numpy(zero_copy_only=False), b.column(1).fill_null("\0")
            ids = b.column(2).to_numpy(zero_copy_only=False)
            ends = np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset : b.column(3).offset + b.num_rows + 1]
            codes = np.frombuffer(b.column(3).buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, size)
            new = (np.diff(lists) != 0) | (names[1:].to_numpy(zero_copy_only=False) != names[:-1].to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                where = (int(lists[i]), b.column(1)[i].as_py())
                if where != at:
                    if n:
                        yield from out(n)
                    at, held, n = where, [], 0
                held.append((ids[i:j], codes[i:j]))
                n += j - i
                if n >= block:
                    yield from out(n - n % block)
                    n %= block
        if n:
            yield from out(n)

    # Blocks of a list may lie in several tasks: a salt from the id spreads a long list.
    spread = rows.repartition("list_id", F.pmod("passage_id", F.lit(16))).sortWithinPartitions("list_id", "domain", "passage_id")
    return spread.mapInArrow(pack, POSTINGS)


def write_postings(postings: DataFrame, path: str, batch: str = "build") -> None:
    """Adds a batch to the store at `path`, in the place of one of that name: a folder per batch and, in it, per list.

    A search reads the lists that it probes. `operators.living` keeps batches that come and go.
    """
    rows = postings.select("list_id", "domain", "passage_ids", "codes", F.lit(batch).alias("batch")).repartition("list_id", F.pmod(F.xxhash64("passage_ids"), F.lit(4)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "list_id").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path).select("list_id", "domain", "passage_ids", "codes")


def of_lists(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """The postings of the lists in `lists` (list_id, one row each; at most the number of lists, so fit for a broadcast).

    Spark prunes the folders at run time by what the broadcast holds.
    """
    return postings.join(F.broadcast(lists.select("list_id").distinct().where("list_id >= 0")), "list_id")


def missing(postings: DataFrame, embeddings: DataFrame, q: Quantiser) -> DataFrame:
    """The vectors that `postings` lacks. A vector is looked for in its own list, and other lists' folders are not read."""
    placed = assign(embeddings, q)
    have = entry_ids(of_lists(postings, placed)).select("list_id", "passage_id")
    return embeddings.where(F.col("embedding").isNotNull()).join(placed.join(have, ["list_id", "passage_id"], "left_anti").select("passage_id"), "passage_id", "left_semi")


def append(postings: DataFrame, embeddings: DataFrame, q: Quantiser, path: str, **how) -> None:
    """Adds the vectors that `postings` lacks to the store at `path`; doing it twice adds nothing."""
    todo = written(missing(postings, embeddings, q), "missing")
    write_postings(encode(todo, q, **how), path, uuid.uuid4().hex)
    discard(todo)


def next_id(rows: DataFrame, key: str) -> int:
    """The id after the largest one."""
    largest = rows.agg(F.max(key)).first()[0]
    return 0 if largest is None else largest + 1


def in_domains(postings: DataFrame, upto: str) -> DataFrame:
    """The snapshot of an index after the domain `upto`: it and the domains before it in order."""
    return postings.where(F.col("domain") <= upto)


_PROBES = "list_id int, coarse double, {vector} array<float>, fetch_k int"


def probes(queries: DataFrame, q: Quantiser, nprobe: int, key: str = "query_id", vector: str = "qvec") -> DataFrame:
    """query_id, list_id, coarse, qvec and fetch_k (null if there is none) of each query's best lists; a column `nprobe` overrides the number."""
    own = "nprobe" if "nprobe" in queries.columns else None
    most = F.coalesce(F.col(own), F.lit(nprobe)) if own else F.lit(nprobe)

    def chosen(score: np.ndarray, most: np.ndarray, x: np.ndarray) -> np.ndarray:
        order = np.argsort(-score, axis=1, kind="stable")
        return [row[:n] for row, n in zip(order, most)]

    return _probed(queries, q, most.cast("int"), chosen, key, vector)


def _probed(queries: DataFrame, q: Quantiser, setting, chosen, key: str = "query_id", vector: str = "qvec") -> DataFrame:
    """One row for each query and list that `chosen` names, from scores by list, each query's `setting`, and the vectors; a query's own fetch_k goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = as_matrix(b.column(1), b.column(0)).astype(np.float64)
            score = x @ q.centroids.T
            picked = chosen(score, b.column(2).to_numpy(zero_copy_only=False), x)
            row, lists = np.repeat(np.arange(len(x)), [len(p) for p in picked]), np.concatenate(picked)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(lists.astype(np.int32)), pa.array(score[row, lists]), b.column(1).take(pa.array(row)), b.column(3).take(pa.array(row))], [key, "list_id", "coarse", vector, "fetch_k"])

    own = F.col("fetch_k").cast("int") if "fetch_k" in queries.columns else F.lit(None).cast("int").alias("fetch_k")
    return with_vectors(queries, key, vector, setting.alias("_setting"), own).mapInArrow(run, f"{key} long, " + _PROBES.format(vector=vector))


def search(queries: DataFrame, postings: DataFrame, q: Quantiser, k: int = 10, nprobe: int = 256) -> DataFrame:
    """query_id, passage_id, score, rank of the best k over the probed lists. Fewer candidates give fewer rows.

    Where not all lists are probed, only the probed ones are read.
    """
    probed = probes(queries, q, nprobe)
    if nprobe < len(q.centroids) or "nprobe" in queries.columns:
        postings = of_lists(postings, probed)
    return scanned(probed, postings, q, k)


def scanned(probed: DataFrame, postings: DataFrame, q: Quantiser, k: int) -> DataFrame:
    """The best k of each query over the lists of its probes (query_id, list_id, qvec, fetch_k).

    The probes of a list are put in blocks of queries, and each block meets the list's posting blocks, by one set of matrix
    operations; a task sends on k rows a query at most, or as many as the query's fetch_k says, if that is less.
    """

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probes, sorted by list, as rows of at most QUERY_BLOCK queries of one list."""
        for b in batches:
            lists = b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                for a in range(i, j, QUERY_BLOCK):
                    part = b.slice(a, min(QUERY_BLOCK, j - a))
                    yield pa.RecordBatch.from_arrays([pa.array([lists[a]], pa.int32()), pa.array([part.column(0).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())), pa.array([as_matrix(part.column(2)).astype(np.float64).tobytes()], pa.binary()), pa.array([part.column(3).fill_null(k).to_numpy(zero_copy_only=False)], pa.list_(pa.int32()))], ["list_id", "query_ids", "vectors", "limits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, distinct=q.border > 1)
        for b in batches:
            for i in range(b.num_rows):
                of = b.column(1)[i].values.to_numpy(zero_copy_only=False)
                x = np.frombuffer(b.column(2)[i].as_py()).reshape(len(of), -1)
                ids = b.column(4)[i].values.to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b.column(5)[i].as_py(), np.uint8).reshape(len(ids), q.code_size)
                if b.column(6)[i].is_valid:
                    live = alive(len(ids), b.column(6)[i])
                    ids, codes = ids[live], codes[live]
                yield from best.add(of, q.score(x, b.column(0)[i].as_py(), codes), ids, b.column(3)[i].values.to_numpy(zero_copy_only=False))
        yield best.out()

    asked = probed.select("query_id", "list_id", "qvec", "fetch_k").repartition("list_id").sortWithinPartitions("list_id").mapInArrow(gathered, "list_id int, query_ids array<long>, vectors binary, limits array<int>")
    met = asked.join(with_dead(postings), "list_id").select("list_id", "query_ids", "vectors", "limits", "passage_ids", "codes", "dead").mapInArrow(run, FOUND)
    if q.border > 1:  # one entry of a vector, the best; queries stay together for the cut
        met = met.repartition("query_id").groupBy("query_id", "passage_id").agg(F.max("score").alias("score"))
    return ranked(met, k)


@dataclass
class Bounds:
    """Of each list, the mean of its vectors and the largest distance from it; no list, no row in `centres` (radius -1)."""

    centres: np.ndarray
    radius: np.ndarray

    def most(self, x: np.ndarray) -> np.ndarray:
        """The largest inner product that a query (row) can have with a vector of a list (column)."""
        bound = x @ self.centres.T + np.linalg.norm(x, axis=1)[:, None] * self.radius
        return np.where(self.radius >= 0, bound, -np.inf)


def bounds(embeddings: DataFrame, q: Quantiser, key: str = "passage_id", vector: str = "embedding") -> Bounds:
    """Two passes over the vectors where they lie; a row per list and task is added up, as in training."""
    rows = with_vectors(embeddings, key, vector).select(vector)
    n, total = _summed(rows, lambda x: (q.assign(x), x), *q.centroids.shape)
    centres = total / np.maximum(n, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(len(centres), -1.0)
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column(0)).astype(np.float64)
                lists = q.assign(x)
                np.maximum.at(far, lists, np.linalg.norm(x - centres[lists], axis=1))
        of = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(far[of])], ["list_id", "far"])

    radius = np.full(len(centres), -1.0)
    for r in rows.mapInArrow(run, "list_id int, far double").groupBy("list_id").agg(F.max("far").alias("far")).collect():
        radius[r.list_id] = r.far
    return Bounds(centres, radius)


def bounded_probes(queries: DataFrame, first: DataFrame, q: Quantiser, b: Bounds, k: int) -> DataFrame:
    """The lists that may hold one of a query's best k, given what a `first` search found (query_id, score)."""
    bar = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    known = queries.join(bar, "query_id", "left")
    wanted = F.least(F.coalesce(F.col("fetch_k"), F.lit(k)), F.lit(k)) if "fetch_k" in queries.columns else F.lit(k)
    setting = F.coalesce(F.when(F.col("_n") >= wanted, F.col("_least")), F.lit(float("-inf")))
    slack = 1e-6  # above what rounding does to scores, bounds and single-precision entries

    def chosen(score: np.ndarray, least: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        most = b.most(x) + slack * (1 + np.abs(least, where=np.isfinite(least), out=np.zeros(len(least))))[:, None]
        return [np.flatnonzero((m >= l) & (b.radius >= 0)) for m, l in zip(most, least)]

    return _probed(known, q, setting.cast("double"), chosen)


def exact_search(queries: DataFrame, postings: DataFrame, q: Quantiser, b: Bounds, k: int = 10, first: int = 1) -> DataFrame:
    """Exactly the best k of each query, from an index of whole vectors, reading only lists that can matter.

    The best `first` lists of a query give k scores to be reached; a list is passed over where a query's inner product with its centre
    and its length times the list's radius stay below them. How many are passed over depends on how the vectors lie: all of
    them must be looked at where there are no clusters.
    """
    if q.codebooks is not None or q.border > 1:
        raise ValueError("exact search needs whole vectors, each in one list")
    found = written(search(queries, postings, q, k, first), "first")
    probed = written(bounded_probes(queries, found, q, b, k), "probes")
    return scanned(probed, of_lists(postings, probed), q, k)


def rescored(found: DataFrame, queries: DataFrame, embeddings: DataFrame, k: int) -> DataFrame:
    """The same candidates by exact score."""
    from ..functions.vectors import inner

    rows = found.select("query_id", "passage_id").join(queries.select("query_id", "qvec"), "query_id").join(embeddings.select("passage_id", "embedding"), "passage_id")
    return ranked(rows.select("query_id", "passage_id", F.round(inner(F.col("qvec"), F.col("embedding")), 9).alias("score")), k)


def lloyd(embeddings: DataFrame, centroids: np.ndarray, rounds: int, vector: str = "embedding") -> np.ndarray:
    """Distributed k-means rounds from given centroids: lists by inner product, then plain means."""
    rows = written(embeddings.select(F.col(vector).cast("array<float>").alias(vector)), "vectors")
    for _ in range(rounds):
        centroids = _coarse_round(rows, centroids, False)
    discard(rows)
    return centroids


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact neighbours that were found."""
    hit = exact.select("query_id", "passage_id").join(found.select("query_id", "passage_id", F.lit(1).alias("hit")), ["query_id", "passage_id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
