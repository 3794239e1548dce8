"""MD5 of many short strings at once (RFC 1321, a column of numpy for each word of the state), for the slots of tokens."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that one block has room for, and strings that are worked on at once, so that they stay in a core's cache.
ROOM, AT_ONCE = 55, 8192


def _first_word(words: np.ndarray) -> np.ndarray:
    """The first word of the state after one block, of which `words` has a row for each of its 16 words."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif kind == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += _SINES[i]
        f += words[g]
        turn = _TURNS[kind][i % 4]
        high = f << np.uint32(turn)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return a + np.uint32(_START[0])


def md5_heads(strings: pa.Array, prefix: bytes) -> np.ndarray:
    """The first 32 bits of the MD5 of `prefix` and each string (string or binary, no nulls), as a number."""
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int32, n + 1, strings.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    out = np.empty(n, np.uint32)
    lead = np.frombuffer(prefix, np.uint8)
    for i in range(0, n, AT_ONCE):
        at = ends[i : i + AT_ONCE + 1]
        size = np.diff(at)
        short = size + len(lead) <= ROOM
        taken = np.where(short, size, 0)
        block = np.zeros((len(size), 64), np.uint8)
        block[:, : len(lead)] = lead
        row = np.repeat(np.arange(len(size)), taken)
        place = np.arange(len(row)) - (np.cumsum(taken) - taken)[row]
        block[row, len(lead) + place] = data[at[row] + place]
        block[np.arange(len(size)), len(lead) + taken] = 0x80
        block[:, 56:58] = ((len(lead) + taken) * 8).astype("<u2")[:, None].view(np.uint8)
        out[i : i + len(size)] = _first_word(np.ascontiguousarray(block.view("<u4").T)).byteswap()
        for j in np.flatnonzero(~short):
            whole = prefix + data[at[j] : at[j + 1]].tobytes()
            out[i + j] = int.from_bytes(hashlib.md5(whole).digest()[:4], "big")
    return out
