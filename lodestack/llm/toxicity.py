"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

The examples are a bounded, hashed sample of at most about `most_examples` labelled rows, whole texts with all their
words. A word's weight in a text is (1 + log of its count there) times its inverse document frequency, counted over all
documents, times its scale: one plus the log-likelihood ratio of its use in toxic and other examples. The scale is a metric
learned from the labels; it leaves no word out (`scaled=False` gives plain TF-IDF). Words that no example has are at right
angles to every example: they would shrink all of a text's cosines alike and are left out of its norm.

Examples that share their strongest common word stand together and are cut into blocks of 64. The index has for each word its
postings, block by block, and each block's largest weight. Words that a sixteenth of the examples have would have postings in
every block; they are rows of a matrix instead, and their part of all cosines is one product for a batch of texts. A text's
bound for a block is the largest such part in it and the sum of its other words' largest weights there; the blocks with the
highest bounds are scored first, and then all others whose bound reaches the k-th best so far, so the k neighbours are exact. They vote by cosine, shrunk to the base rate, and a logistic curve fitted to
leave-one-out votes makes the votes probabilities. Neighbours are returned as evidence.

Documents are read where they lie, once to count words and once to be scored; nothing is shuffled but one count per word
and task. The driver holds the examples, their words and index, all bounded by `most_examples` texts.

Defined cases: a text that is null or has none of the words has no neighbours and gets the calibrated base rate; a document with
several labels is toxic if one says so; ties in cosine go to the example with the least doc_id; without labels, or
with one kind of label only, every score is the base rate (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, written

SEED, MOST_EXAMPLES, NEIGHBOURS, BLOCK = 42, 4000, 25, 64
#: Texts that are scored at once.
BATCH = 64
#: Weight of the base rate among the votes, in neighbours at cosine 1.
SHRINK = 0.5
#: Scores that a task keeps for further copies of a text, about.
KEPT = 100_000

_WORD = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> list[str]:
    """Runs of letters and numbers, in lower case."""
    return _WORD.findall((text or "").lower())


def choose_examples(labels: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of a hashed sample of `labels` (doc_id, toxic), about `most` rows."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(1, one.count()))
    return one.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))


def scales(counts: list[np.ndarray], toxic: np.ndarray, n_words: int) -> np.ndarray:
    """One plus each word's log-likelihood ratio between the toxic examples and the others; `counts` has each example's distinct words."""
    hits, misses = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(w for w, t in zip(counts, toxic) if t == k)]), minlength=n_words).astype(float) for k in (1, 0))
    n = np.array([toxic.sum(), len(toxic) - toxic.sum()], float)
    share = (hits + misses) / max(n.sum(), 1)
    ratio = np.zeros(n_words)
    for seen, of in ((hits, n[0]), (misses, n[1])):
        for x, e in ((seen, share * of), (of - seen, (1 - share) * of)):
            ratio += np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return 1 + 2 * np.maximum(ratio, 0)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class BlockMaxIndex:
    """Postings of each word in runs of blocks, with each run's largest weight. Examples are given as (words, weights)."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_words: int, block: int = BLOCK):
        self.n, self.block, sizes = len(vectors), block, [len(w) for w, _ in vectors]
        self.n_blocks = -(-self.n // block)
        words = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(x for _, x in vectors)])
        common = np.bincount(words, minlength=n_words) >= max(2, self.n // 50)
        leader = np.full(self.n, -1)
        for i, (w, x) in enumerate(vectors):
            if common[w].any():
                leader[i] = w[np.where(common[w], x, -1).argmax()]
        self.names = np.argsort(leader, kind="stable")  # place in the index to example
        place = np.empty(self.n, np.int64)
        place[self.names] = np.arange(self.n)
        at = np.repeat(place, np.array(sizes, np.int64)) if self.n else np.zeros(0, np.int64)
        order = np.lexsort((at, words))
        words, self.at, self.weights = words[order], at[order], weights[order]
        self.frequent = np.flatnonzero(np.bincount(words, minlength=n_words) * 16 >= max(self.n, 16))
        self.word_ends = np.searchsorted(words, np.arange(n_words + 1))
        new = np.flatnonzero((np.diff(words, prepend=-1) != 0) | (np.diff(self.at // block, prepend=-1) != 0))
        self.run_starts, self.run_block = np.append(new, len(words)), self.at[new] // block
        self.run_most = np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        self.word_runs = np.searchsorted(words[new], np.arange(n_words + 1))

    @functools.cached_property
    def matrix(self) -> np.ndarray:
        """Weights of the frequent words, a row for each; made from the postings where it is used, since it is larger than they are."""
        out = np.zeros((len(self.frequent), self.n_blocks * self.block))
        for row, w in enumerate(self.frequent):
            of = slice(self.word_ends[w], self.word_ends[w + 1])
            out[row, self.at[of]] = self.weights[of]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "matrix"}

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each text, as (words, weights), the k largest positive cosines and their examples, least example first among equals."""
        if not self.n:
            return [[] for _ in texts]
        asked = np.zeros((len(texts), len(self.frequent)))
        rest = []
        for i, (words, x) in enumerate(texts):
            row = np.searchsorted(self.frequent, words)
            often = np.zeros(len(words), bool)
            inside = row < len(self.frequent)
            often[inside] = self.frequent[row[inside]] == words[inside]
            asked[i, row[often]] = x[often]
            rest.append((words[~often], x[~often]))
        return [self._best(score, words, x, k) for score, (words, x) in zip(asked @ self.matrix, rest)]

    def _best(self, score: np.ndarray, words: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """`score` has the frequent words' part, and gets the others' in the blocks that can matter."""
        sizes = self.word_runs[words + 1] - self.word_runs[words]
        runs, x = _spread(self.word_runs[words], sizes), np.repeat(weights, sizes)
        bound = score.reshape(-1, self.block).max(axis=1) + np.bincount(self.run_block[runs], x * self.run_most[runs], self.n_blocks)
        first = np.zeros(self.n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[:8]] = True
        self._score(score, first, runs, x)
        k = min(k, len(score))
        others = ~first & (bound > 0) & (bound + 1e-9 >= np.partition(score, -k)[-k])
        if others.any():
            self._score(score, others, runs, x)
        # Where a block was passed over, its parts are below the k-th best, whatever they lack.
        score = np.where(np.repeat(first | others, self.block), score, 0.0)[: self.n]
        k = min(k, self.n)
        hit = np.flatnonzero((score > 0) & (score + 1e-9 >= np.partition(score, -k)[-k]))
        score, names = np.round(score[hit], 12), self.names[hit]
        best = np.lexsort((names, -score))[:k]
        return list(zip(score[best].tolist(), names[best].tolist()))

    def _score(self, score: np.ndarray, blocks: np.ndarray, runs: np.ndarray, x: np.ndarray) -> None:
        of = blocks[self.run_block[runs]]
        runs, x = runs[of], x[of]
        sizes = self.run_starts[runs + 1] - self.run_starts[runs]
        i = _spread(self.run_starts[runs], sizes)
        score += np.bincount(self.at[i], self.weights[i] * np.repeat(x, sizes), len(score))


class Votes:
    """Words, index, labels and calibration; small enough to send to every task, since examples are bounded."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[int, int, Counter]], rate: float, k: int = NEIGHBOURS, scaled: bool = True):
        examples = sorted(examples, key=lambda e: e[:2])
        self.ids, self.rate, self.k, self.line = {w: i for i, w in enumerate(vocabulary)}, rate, k, None
        self.names, self.toxic = [e[0] for e in examples], np.array([e[1] for e in examples], int)
        counted = [self._counted(e[2]) for e in examples]
        self.weight = idf * scales([w for w, _ in counted], self.toxic, len(vocabulary)) if scaled else idf
        vectors = [self._weighed(*c) for c in counted]
        self.index = BlockMaxIndex(vectors, len(vocabulary))
        if 0 < self.toxic.sum() < len(examples):
            near = [r for i in range(0, len(vectors), BATCH) for r in self.index.nearest(vectors[i : i + BATCH], k + 1)]
            self.line = self._calibrated([self.vote([r for r in rows if r[1] != i][:k]) for i, rows in enumerate(near)])

    def _counted(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        return self._numbered([w for w, n in counts.items() for _ in range(n)])

    def _numbered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the known words of a text, in order of number."""
        at = np.array(list(map(self.ids.get, words, repeat(-1))), np.int64)
        at, n = np.unique(at[at >= 0], return_counts=True)
        return at, n.astype(float)

    def _weighed(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.weight[words]
        return words, x / (math.sqrt((x * x).sum()) or 1.0)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of a text's words, at length 1."""
        return self._weighed(*self._counted(counts))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours by cosine, as log odds."""
        share = (sum(s * self.toxic[i] for s, i in near) + SHRINK * self.rate) / (sum(s for s, _ in near) + SHRINK)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return math.log(share / (1 - share))

    def _calibrated(self, votes: list[float]) -> tuple[float, float]:
        """Slope and intercept of a logistic curve from votes to labels, lightly held to (1, 0)."""
        x, line = np.stack([np.array(votes), np.ones(len(votes))], axis=1), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
            g = x.T @ (p - self.toxic) + (line - [1, 0])
            h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
            step = np.linalg.solve(h, g)
            line = line - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-10:
                break
        return float(max(line[0], 1e-3)), float(line[1])

    def scores(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        """Each text's score and its nearest examples."""
        if not self.line:
            return [(float(self.rate), [])] * len(texts)
        out = []
        for near in self.index.nearest([self._weighed(*self._numbered(text_words(t))) for t in texts], self.k):
            z = self.line[0] * self.vote(near) + self.line[1]
            out.append((1 / (1 + math.exp(-min(max(z, -30), 30))), [{"doc_id": self.names[i], "cosine": s, "toxic": int(self.toxic[i])} for s, i in near[:3]]))
        return out


def document_counts(docs: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """In how many of all `docs` (text) each word of `vocabulary` stands: one row per word and task, added up by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = {w: i for i, w in enumerate(vocabulary)}, np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for t in b.column(0):
                at = np.array(list(map(ids.get, set(text_words(t.as_py())), repeat(-1))), np.int64)
                n[at[at >= 0]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["word", "n"])

    sums = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return out


def learned(docs: DataFrame, labels: DataFrame, most_examples: int = MOST_EXAMPLES, k: int = NEIGHBOURS, scaled: bool = True) -> Votes:
    sample = written(choose_examples(labels, most_examples), "examples")
    # The sample's bound makes it fit for a broadcast: 12 bytes a row.
    rows = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(text_words(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "counts"])

    examples = [(r["doc_id"], r["toxic"], Counter(dict(zip(r["words"], r["counts"])))) for b in rows.mapInArrow(counted, "doc_id long, toxic int, words array<string>, counts array<long>").toArrow().to_batches() for r in b.to_pylist()]
    vocabulary = sorted(set().union(*(c for _, _, c in examples)))
    n = docs.count()
    idf = np.log((1 + n) / (1 + document_counts(docs, vocabulary))) if vocabulary else np.zeros(0)
    rate = sum(t for _, t, _ in examples) / len(examples) if examples else 0.0
    return Votes(vocabulary, np.maximum(idf, 0), examples, rate, k, scaled)


def scored(docs: DataFrame, labels: DataFrame, most_examples: int = MOST_EXAMPLES, k: int = NEIGHBOURS, scaled: bool = True) -> DataFrame:
    """doc_id, score, and evidence (the nearest examples) of every row of `docs` (doc_id long, text), learned from `labels`."""
    docs = docs.select("doc_id", "text")
    votes = learned(docs, labels, most_examples, k, scaled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple] = {}  # by a text's digest: copies are scored once
        for b in batches:
            keys, new = [], {}
            for t in b.column(1):
                text = t.as_py() or ""
                keys.append(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest())
                if keys[-1] not in kept:
                    new[keys[-1]] = text
            if len(kept) >= KEPT:
                kept = {key: kept[key] for key in keys if key in kept}
            todo = list(new)
            for i in range(0, len(todo), BATCH):
                kept.update(zip(todo[i : i + BATCH], votes.scores([new[key] for key in todo[i : i + BATCH]])))
            out = [kept[key] for key in keys]
            evidence = pa.array([e for _, e in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")


def op8_toxicity(spark, sf_dir):
    from .common import documents

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket(F.col("doc_id"), 5) != 0)
    out = scored(documents(spark, sf_dir), labels.select("doc_id", "toxic"))
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
