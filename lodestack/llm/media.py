"""Media columns: texts or bytes stored as PNG in binary columns, read back with every checksum tested.

`to_png` writes, `read_png` reads any non-interlaced 8-bit PNG, and `describe` adds digests and a low-frequency
cosine-transform hash. All three are per-row Arrow batches inside the scan's stage: nothing is shuffled, and
memory is one batch.

Defined cases: a null text is the empty text; the payload is padded with zero bytes to a positive multiple of
64, so the empty text is one row of zeros; equal texts give equal files, digests and features; a null or damaged
file, and one that would open to more than `MOST_BYTES`, gives a null payload and its reason in `error`, never a failed job; other columns are carried unchanged
under the caller's choice.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Most bytes of compressed data in one IDAT chunk.
CHUNK = 1 << 20
#: Largest side that the format allows, and most bytes that a file may open to unless the caller says otherwise.
LARGEST_SIDE, MOST_BYTES = (1 << 31) - 1, 1 << 29
#: Bytes that are decompressed at once.
STEP = 1 << 20
#: Samples per pixel of each PNG colour type.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class Damaged(ValueError):
    """The bytes are not a sound PNG of a kind read here."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit PNG, 64 samples wide; the filter is the one whose residuals have the least entropy."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def bits(x: np.ndarray) -> float:
        n = np.bincount(x.ravel(), minlength=256)
        n = n[n > 0] / x.size
        return float(-(n * np.log2(n)).sum())

    sub = image.copy()
    sub[:, 1:] -= image[:, :-1]
    up = image.copy()
    up[1:] -= image[:-1]
    best, rows = min(((NONE, image), (SUB, sub), (UP, up)), key=lambda x: bits(x[1]))
    lines = np.empty((len(image), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = rows
    data = zlib.compress(lines.tobytes(), level)
    parts = [_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def _wave(rest: np.ndarray, prior: np.ndarray, paeth: bool) -> np.ndarray:
    """Average or Paeth rows, undone along anti-diagonals: each depends on the two before it alone."""
    h, w, n = rest.shape
    out = np.zeros((h + 1, w + 1, n), np.int32)
    out[0, 1:] = prior
    for s in range(h + w - 1):
        r = np.arange(max(0, s - w + 1), min(h, s + 1))
        c = s - r
        left, above = out[r + 1, c], out[r, c + 1]
        if paeth:
            corner = out[r, c]
            p = left + above - corner
            da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        else:
            guess = (left + above) >> 1
        out[r + 1, c + 1] = (rest[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def unfilter(lines: np.ndarray, width: int, samples: int) -> np.ndarray:
    """Undo the row filters; runs of rows with one filter are undone together."""
    kinds, rest = lines[:, 0], lines[:, 1:].reshape(len(lines), width, samples)
    if kinds.max(initial=0) > PAETH:
        raise Damaged("unknown row filter")
    out = np.empty_like(rest)
    prior = np.zeros((width, samples), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(lines)]])
    for a, b in zip(starts[:-1], starts[1:]):
        kind, run = kinds[a], rest[a:b]
        if kind == NONE:
            out[a:b] = run
        elif kind == SUB:
            out[a:b] = run.cumsum(axis=1, dtype=np.uint8)
        elif kind == UP:
            out[a:b] = run.cumsum(axis=0, dtype=np.uint8) + prior
        else:
            out[a:b] = _wave(run, prior, kind == PAETH)
        prior = out[b - 1]
    return out


def _opened(data: bytes, size: int) -> bytes:
    """What `data` decompresses to, which must be `size` bytes; in steps, so that memory follows what is there and not what a header says."""
    stream, out = zlib.decompressobj(), bytearray()
    try:
        while not stream.eof and len(out) <= size:
            part = stream.decompress(data, min(STEP, size + 1 - len(out)))
            data = stream.unconsumed_tail
            if not part and not data:
                break
            out += part
    except zlib.error as e:
        raise Damaged(f"data: {e}") from e
    if len(out) != size or not stream.eof or stream.unused_data:
        raise Damaged("wrong amount of data")
    return bytes(out)


def decode(png: bytes, most: int = MOST_BYTES) -> np.ndarray:
    """The samples of a PNG, (rows, columns, samples); every chunk's checksum and the stream's are tested. Above `most` bytes it is not opened."""
    if png[:8] != SIGNATURE:
        raise Damaged("no PNG signature")
    at, head, data, ended, last = 8, None, [], False, b""
    while not ended:
        if at + 12 > len(png):
            raise Damaged("cut off")
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body, crc = png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise Damaged("chunk checksum")
        if (kind == b"IHDR") != (at == 8) or kind == b"IDAT" and data and last != b"IDAT":
            raise Damaged("chunks out of order")
        if kind == b"IHDR":
            if n != 13:
                raise Damaged("header of a wrong size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif not kind[0] & 32 and kind not in (b"IEND", b"PLTE"):
            raise Damaged("unknown chunk that must be understood")
        ended, last = kind == b"IEND", kind
        at += 12 + n
    if head[2] != 8 or head[3] not in SAMPLES or any(head[4:]):
        raise Damaged("not an 8-bit, non-interlaced, unindexed image with the one compression and filter method")
    width, height, samples = head[0], head[1], SAMPLES[head[3]]
    if not width or not height:
        raise Damaged("no samples")
    size = height * (width * samples + 1)
    if max(width, height) > LARGEST_SIDE or size > most:
        raise Damaged(f"{width} by {height} is too large")
    raw = _opened(b"".join(data), size)
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), width, samples)


_SIDE, _LOW = 32, 8
#: Cosine basis in whole numbers, so that a hash never depends on a machine's rounding.
_COSINES = np.rint(1024 * np.cos(np.pi * (np.arange(_SIDE) + 0.5) * np.arange(_LOW)[:, None] / _SIDE)).astype(np.int64)


def _shrunk(x: np.ndarray) -> np.ndarray:
    """32 means along the first axis, or repeats where there are fewer rows."""
    edges = np.arange(_SIDE + 1) * len(x) // _SIDE
    if len(x) < _SIDE:
        return x[edges[:-1]]
    return np.add.reduceat(x, edges[:-1], axis=0) // np.diff(edges)[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: the lowest 8 x 8 cosine coefficients of the 32 x 32 picture, each against their median."""
    grey = image.astype(np.int64).sum(axis=2)
    small = _shrunk(_shrunk(grey).T).T
    low = (_COSINES @ small @ _COSINES.T).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def to_png(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), level: int = 6) -> DataFrame:
    """`carry`, n_bytes (of the text, unpadded) and media (the PNG)."""
    picked = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_payload"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column(b.num_columns - 1)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, texts), pa.int64()), pa.array([encode(padded(x), level) for x in texts], pa.binary())], [f.name for f in schema])

    return picked.mapInArrow(run, schema)


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def describe(media: DataFrame, carry: Sequence[str] = ("doc_id", "n_bytes"), column: str = "media") -> DataFrame:
    """`carry` and what is read back from each file: digests, sizes, the hash; `error` where it is damaged or null."""
    picked = media.select(*carry, F.col(column).alias("_media"))
    schema = T.StructType([*picked.schema.fields[:-1], *T._parse_datatype_string(_READ).fields])

    def one(png: bytes | None) -> dict:
        if png is None:
            return {"error": "no file"}
        out = {"media_bytes": len(png), "media_sha256": hashlib.sha256(png).hexdigest()}
        try:
            image = decode(png)
        except Damaged as e:
            return out | {"error": str(e)}
        payload = image.tobytes()
        return out | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": cosine_hash(image)}

    kinds = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(x.as_py()) for x in b.column(b.num_columns - 1)]
            new = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *new], [f.name for f in schema])

    return picked.mapInArrow(run, schema)


def read_png(media: DataFrame, carry: Sequence[str] = ("doc_id", "n_bytes"), column: str = "media") -> DataFrame:
    """`carry` and payload (the stored bytes without padding, if n_bytes is carried), or null and `error`."""
    picked = media.select(*carry, F.col(column).alias("_media"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("n_bytes").to_pylist() if "n_bytes" in carry else [None] * b.num_rows
            out, errors = [], []
            for png, n in zip(b.column(b.num_columns - 1), sizes):
                try:
                    out.append(decode(png.as_py() or b"").tobytes()[:n])
                    errors.append(None)
                except Damaged as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [f.name for f in schema])

    return picked.mapInArrow(run, schema)


def op2_media_columns(spark, sf_dir):
    from .common import documents

    return describe(to_png(documents(spark, sf_dir))).drop("error")
