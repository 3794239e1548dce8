"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows.

A text's UTF-8 bytes are cut into windows of 128 bytes; each goes through byte embeddings, filters of several
widths, max pooling and a softmax layer, and a text's language is that of its windows' mean log probability. Applied,
embedding and filters are one table lookup per byte pair, so batches run at numpy speed and memory is a few
thousand windows, whatever the text's length.

The network is fitted on the driver to a bounded, hashed sample: at most about `docs_per_lang` labelled documents of
each language and `windows_per_doc` windows of each. Labels' counts come from all rows.

Defined cases: a null text, or one without letters, is `und` with score 0; so is every text where nothing could be
learned; rows may repeat; a null doc_id is held out from learning; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket

WINDOW, WIDTHS = 128, (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
SEED, DOCS_PER_LANG, WINDOWS_PER_DOC = 42, 1500, 4
NOBODY = "und"
#: Windows that are scored at once, of one document or of many.
BATCH = 4096


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes; neighbours overlap by what the widest filter needs; zeros fill the last one."""
    n = max(1, -(-(len(data) - WINDOW + STRIDE) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class ByteCNN:
    def __init__(self, langs: list[str], size: int = 8, filters: int = 16, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs, self.filters = langs, filters
        self.p = {"emb": rng.normal(0, 0.5, (256, size)), "out": rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))), "bias": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * size) ** -0.5, (w, size, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        p, e, values, places = self.p, self.p["emb"][x], [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            c = sum(e[:, k : k + n] @ p[f"w{w}"][k] for k in range(w)) + p[f"b{w}"]
            at = c.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(c, at[:, None], axis=1)[:, 0])
        return np.concatenate(values, axis=1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.01, seed: int = SEED) -> ByteCNN:
        """Adam on the cross-entropy; gradients go through the pooled places alone."""
        rng, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xb, n = x[rows], len(rows)
                raw, places = self._pooled(xb)
                h = np.maximum(raw, 0)
                z = h @ p["out"] + p["bias"]
                z -= z.max(axis=1, keepdims=True)
                q = np.exp(z)
                q /= q.sum(axis=1, keepdims=True)
                q[np.arange(n), y[rows]] -= 1
                q /= n
                g = {"out": h.T @ q, "bias": q.sum(axis=0), "emb": np.zeros_like(p["emb"])}
                back = (q @ p["out"].T) * (raw > 0)
                for j, w in enumerate(WIDTHS):
                    b, at = back[:, j * self.filters : (j + 1) * self.filters], places[j]
                    g[f"b{w}"], g[f"w{w}"] = b.sum(axis=0), np.empty_like(p[f"w{w}"])
                    for k in range(w):
                        byte = np.take_along_axis(xb, at + k, axis=1)
                        g[f"w{w}"][k] = np.einsum("nfe,nf->ef", p["emb"][byte], b, optimize=True)
                        np.add.at(g["emb"], byte.ravel(), (b[:, :, None] * p[f"w{w}"][k].T[None]).reshape(-1, p["emb"].shape[1]))
                t += 1
                step = rate * (1 - epoch / epochs)
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> list[tuple[int, list[np.ndarray]]]:
        """For each width, the filters' answers to each byte pair (and last byte) as lookup tables."""
        out = []
        for w in WIDTHS:
            one = [self.p["emb"] @ self.p[f"w{w}"][k] for k in range(w)]
            pairs = [(one[k][:, None] + one[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            out.append((w, pairs + [one[-1]] * (w % 2)))
        return out

    def log_probabilities(self, x: np.ndarray, tables, step: int = 512) -> np.ndarray:
        out = []
        for i in range(0, len(x), step):
            xb = x[i : i + step].astype(np.int32)
            two = xb[:, :-1] << 8 | xb[:, 1:]
            pooled = []
            for w, parts in tables:
                n = WINDOW - w + 1
                c = parts[0][two[:, :n]]
                for k, part in enumerate(parts[1:], 1):
                    c += part[two[:, 2 * k : 2 * k + n] if len(part) > 256 else xb[:, 2 * k : 2 * k + n]]
                pooled.append(np.maximum(c.max(axis=1) + self.p[f"b{w}"], 0))
            z = np.concatenate(pooled, axis=1) @ self.p["out"] + self.p["bias"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)


def sample_windows(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC) -> list:
    """(lang, windows) rows of the sample of `labelled` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    shares = pa.Table.from_pylist([{"of": r.lang, "most": int(min(1.0, docs_per_lang / r.n) * (1 << 30))} for r in counts], pa.schema([("of", pa.string()), ("most", pa.int64())]))
    shares = spark.createDataFrame(shares, "of string, most long")
    picked = labelled.join(shares, labelled.lang == shares.of).where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.col("most")).select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for t in b.column(1):
                x = windows(t.as_py())
                parts.append(np.ascontiguousarray(x[np.unique(np.arange(windows_per_doc) * len(x) // windows_per_doc)]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], ["lang", "windows"])

    return picked.mapInArrow(run, "lang string, windows binary").collect()


def train(labelled: DataFrame, **how) -> ByteCNN | None:
    """A network for the languages of `labelled` (doc_id, text, lang), or None where there are no rows."""
    rows = sorted((r.lang, bytes(r.windows)) for r in sample_windows(labelled.where("lang is not null and text is not null"), **how))
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    x = np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in rows])
    y = np.concatenate([np.full(len(w) // WINDOW, langs.index(lang)) for lang, w in rows])
    # Few rows get more passes, so that the number of steps is about the same.
    return ByteCNN(langs).fit(x, y, epochs=int(np.clip(60_000 // len(x), 4, 60)))


def predict(docs: DataFrame, model: ByteCNN | None, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`carry`, lang_pred and score of every whole text."""
    picked = docs.select(*carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None  # made in the task: 2 MB that need not be sent
        langs = model.langs if model else [NOBODY]
        for b in batches:
            total, n, held, held_n = np.zeros((b.num_rows, len(langs))), np.zeros(b.num_rows), [], 0

            def flush(total=total, held=held) -> None:
                """Adds the log probabilities of the windows held, of whichever documents, to their documents' sums."""
                if held:
                    p = model.log_probabilities(np.concatenate([x for _, x in held]), tables)
                    starts = np.cumsum([0, *(len(x) for _, x in held[:-1])])
                    np.add.at(total, [i for i, _ in held], np.add.reduceat(p, starts, axis=0))
                    held.clear()

            for i, t in enumerate(b.column(b.num_columns - 1)):
                t = t.as_py()
                if model is None or t is None or not any(map(str.isalpha, t)):
                    continue
                x = windows(t.encode("utf-8", "replace"))
                n[i] = len(x)
                for j in range(0, len(x), BATCH):
                    held.append((i, x[j : j + BATCH]))
                    held_n += len(held[-1][1])
                    if held_n >= BATCH:
                        flush()
                        held_n = 0
            flush()
            mean = total / np.maximum(n, 1)[:, None]
            z = np.exp(mean - mean.max(axis=1, keepdims=True))
            best = z.argmax(axis=1)
            score = np.where(n > 0, z[np.arange(len(z)), best] / z.sum(axis=1), 0.0)
            new = [pa.array([langs[k] if m else NOBODY for k, m in zip(best, n)], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *new], [*b.schema.names[:-1], "lang_pred", "score"])

    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op3_language_id(spark, sf_dir):
    from .common import documents

    docs = documents(spark, sf_dir).withColumn("held_out", bucket(F.col("doc_id"), 4) == 2)
    model = train(docs.where("doc_id is not null and not held_out").select("doc_id", "text", "lang"))
    return predict(docs, model, ("doc_id", "held_out"))
