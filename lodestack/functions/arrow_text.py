"""Tokens of whole Arrow batches of texts, as `functions.text` says them row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tokens each text (string or binary; null: none) has, and all tokens in order: `functions.text.tokens` of every row."""
    if not pa.types.is_string(texts.type):
        texts = texts.view(pa.string())  # bytes are looked at, so they need not be valid
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    n, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    empty = pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0  # at white space before the first token and after the last
    if empty.any():
        n = n - np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        flat = flat.filter(pa.array(~empty))
    return n, flat


def n_chunks(n: np.ndarray, size: int, least_last: int) -> np.ndarray:
    """`functions.text.n_chunks` of numbers of tokens."""
    full, rest = n // size, n % size
    return np.where(n == 0, 0, np.where(full == 0, 1, full + (rest >= least_last)))


def chunk_count(texts: pa.Array, size: int, least_last: int) -> np.ndarray:
    """How many chunks each text gives."""
    return n_chunks(split(texts)[0], size, least_last)


def cut(texts: pa.Array, size: int, least_last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all chunks of the texts, in order: the text's row, the chunk's index, its number of tokens, and the tokens joined by a blank."""
    n, flat = split(texts)
    made = n_chunks(n, size, least_last)
    row = np.repeat(np.arange(len(n)), made)
    index = np.arange(len(row)) - (np.cumsum(made) - made)[row]
    ends = np.append((np.cumsum(n) - n)[row] + index * size, len(flat))  # chunks follow one another without a gap
    parts = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
    return row, index, np.diff(ends), pc.binary_join(parts, " ")
