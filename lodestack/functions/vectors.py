"""Vector expressions and blocks of vectors for matrix arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def negative_distance(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask is not 0; null where none is."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(pairs, zero, lambda a, p: F.zip_with(a, p["v"], lambda x, y: x + y * p["m"]))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def as_matrix(column: pa.Array, ids: pa.Array | None = None) -> np.ndarray:
    """An Arrow column of equally long lists of numbers as a matrix; an error names the first row that does not fit, by `ids` if given."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if len(sizes) and ((sizes != sizes[0]).any() or sizes[0] < 0):
        i = int(np.flatnonzero((sizes != sizes[0]) | (sizes < 0))[0])
        raise ValueError(f"vector {ids[i].as_py() if ids is not None else i} is {'null' if sizes[i] < 0 else f'of length {sizes[i]}, not {sizes[0]}'}")
    if flat.null_count:
        i = int(np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))[0]) // int(sizes[0])
        raise ValueError(f"vector {ids[i].as_py() if ids is not None else i} has a null entry")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_vectors(rows: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    """key (long), vector (floats) and `more` of the rows that have a vector."""
    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<float>").alias(vector), *more)


BLOCK = "ids array<long>, dim int, vectors binary"


def blocks(rows: DataFrame, key: str, vector: str, size: int = 4096, number: Column | None = None) -> DataFrame:
    """Rows of at most `size` vectors (float32) each, cut where they lie; vectors that are null are left out. With a `number` for each, these too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out(ids: np.ndarray, x: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
            more = [pa.array([v.tolist()], pa.list_(pa.int32())) for v in numbers]
            return pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(x, np.float32).tobytes()], pa.binary()), *more], ["ids", "dim", "vectors", "numbers"][: 3 + len(more)])

        def joined() -> list[np.ndarray]:
            return [np.concatenate(parts) for parts in zip(*held)]

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(zero_copy_only=False), as_matrix(b.column(1), b.column(0)), *(c.to_numpy(zero_copy_only=False) for c in b.columns[2:])))
            n += b.num_rows
            if n >= size:
                all_, whole = joined(), n - n % size
                for i in range(0, whole, size):
                    yield out(*(a[i : i + size] for a in all_))
                held, n = [tuple(a[whole:] for a in all_)], n - whole
        if n:
            yield out(*joined())

    more = [] if number is None else [number.cast("int").alias("_number")]
    return with_vectors(rows, key, vector, *more).mapInArrow(run, BLOCK + ", numbers array<int>" * len(more))


def from_block(ids: pa.Scalar, dim: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return ids.values.to_numpy(zero_copy_only=False), np.frombuffer(data, np.float32).reshape(-1, dim).astype(np.float64)
