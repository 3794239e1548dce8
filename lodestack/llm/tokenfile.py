"""Token files: each document's ids compressed alone under one shared zstandard dictionary.

A token file is a Parquet file whose rows are blocks of documents in ascending doc_id order, so any store that
Spark writes to will do. A block's `data` is: magic, SHA-256 of the dictionary, the number of documents, an index
of frame offsets, the token counts, then one zstandard frame per document. A short document is read by seeking
its frame in the index, without the others. The dictionary, at most `dictionary_bytes`, is trained on the
serialized ids of a bounded, hashed sample (`sample_docs` documents, of each at most `sample_bytes` of ids) and stored
beside the blocks; where the sample is too small to train on, it is empty.

Documents are dealt by ranges of doc_id and sorted within tasks; only one number per task, its tokens, goes to
the driver, for the running start.

Defined cases: a null or empty text is the end id alone; null ids come first; rows that repeat a doc_id follow each
other, ordered by text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, table_partitions
from .tokens import encoded, vocabulary

MAGIC = b"IDZ1"
SEED, SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 42, 1000, 16_384, 32_768
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: Tokens of one block that are held at a time when it is read.
READ_TOKENS = 1 << 20
#: Words that a worker keeps in front of the tokenizer (100 MB).
KEPT_WORDS = 500_000
_BLOCKS = T.StructType([T.StructField("part", T.LongType()), T.StructField("first_token", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])


def train_dictionary(docs: DataFrame, path: str, drops_space: bool = False, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    import zstandard

    rows = docs.count()
    share = min(1.0, sample_docs / max(rows, 1))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").limit(2 * sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ids[:sample_bytes] for _, ids in encoded(b.column(0), path, drops_space)], pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in picked.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_block(frames: list[bytes], tokens: list[int], dictionary_hash: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return MAGIC + dictionary_hash + struct.pack("<I", len(frames)) + offsets.tobytes() + np.array(tokens, "<u4").tobytes() + b"".join(frames)


class Block:
    """A block's bytes, any document of which can be read alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[:4] != MAGIC or data[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token block, or of another dictionary")
        (self.n,) = struct.unpack_from("<I", data, 36)
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, 40).astype(np.int64)
        at = 40 + 8 * (self.n + 1)
        self.tokens = np.frombuffer(data, "<u4", self.n, at)
        self.body = memoryview(data)[at + 4 * self.n :]
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> bytes:
        """Document i's ids, little-endian unsigned 32-bit."""
        return self.zstd.decompress(self.body[self.offsets[i] : self.offsets[i + 1]], max_output_size=4 * int(self.tokens[i]))


def write_tokens(docs: DataFrame, to: str, path: str | None = None, drops_space: bool = False, level: int = 3, **how) -> None:
    """Writes `to`/dictionary and `to`/blocks for `docs` (doc_id long, text)."""
    spark, path = docs.sparkSession, path or vocabulary("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, path, drops_space, **how)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{to}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zstd, digest, part = zstandard.ZstdCompressor(level=level, dict_data=shared), hashlib.sha256(dictionary).digest(), TaskContext.get().partitionId()
        names, frames, tokens, size, done = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            columns = [[part], [done], [len(frames)], [sum(tokens)], [names], [pack_block(frames, tokens, digest)]]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _BLOCKS.fieldNames())

        for b in batches:
            for i, ids in encoded(b.column(1), path, drops_space, KEPT_WORDS):
                names.append(b.column(0)[i].as_py())
                frames.append(zstd.compress(ids))
                tokens.append(len(ids) // 4)
                size += len(frames[-1])
                if len(frames) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    done += sum(tokens)
                    names, frames, tokens, size = [], [], [], 0
        if frames:
            yield block()

    dealt = docs.repartitionByRange(table_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, _BLOCKS).write.parquet(f"{to}/blocks")


def dictionary_of(spark: SparkSession, at: str) -> bytes:
    return bytes(spark.read.schema("dictionary binary").parquet(f"{at}/dictionary").first()[0])


def read_tokens(spark: SparkSession, at: str, columns: str = "ids array<long>") -> DataFrame:
    """doc_id, start, n_tokens and `columns` (ids, or ids_crc32 long) of every document in the files."""
    dictionary = dictionary_of(spark, at)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{at}/blocks")
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append({"part": part, "before": total})
        total += n
    table = spark.createDataFrame(pa.Table.from_pylist(starts, pa.schema([("part", pa.int64()), ("before", pa.int64())])), "part long, before long")
    digest_only = columns.startswith("ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, start = Block(b.column(2)[i].as_py(), dictionary), b.column(0)[i].as_py()
                tokens = block.tokens.astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(tokens)[:-1]])
                k = 0
                while k < block.n:  # frames of one token or many: as many at a time as READ_TOKENS allows, and one at least
                    to = max(k + 1, int(np.searchsorted(np.cumsum(tokens[k:]), READ_TOKENS, "right")) + k)
                    ids = [block.ids(j) for j in range(k, to)]
                    last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest_only else pa.array([array("I", x).tolist() for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([b.column(1)[i].values[k:to], pa.array(starts[k:to]), pa.array(tokens[k:to]), last], ["doc_id", "start", "n_tokens", columns.split()[0]])
                    k = to

    placed = blocks.join(table, "part").select((F.col("before") + F.col("first_token")).alias("start"), "doc_ids", "data")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {columns}")


def lookup(spark: SparkSession, at: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the few documents named: their blocks are found by id, and only their frames are opened."""
    dictionary, wanted = dictionary_of(spark, at), set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, data in zip(b.column(0).to_pylist(), b.column(1)):
                block = Block(data.as_py(), dictionary)
                at = [i for i, x in enumerate(names) if x in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.int64()), pa.array([array("I", block.ids(i)).tolist() for i in at], pa.list_(pa.int64()))], ["doc_id", "ids"])

    blocks = spark.read.schema(_BLOCKS).parquet(f"{at}/blocks")
    found = blocks.where(F.arrays_overlap("doc_ids", F.array(*(F.lit(x).cast("long") for x in wanted)))) if wanted else blocks.limit(0)
    return found.select("doc_ids", "data").mapInArrow(run, "doc_id long, ids array<long>")


def op5_token_output(spark, sf_dir):
    from .common import documents

    to = shared_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), to)
    return read_tokens(spark, to, "ids_crc32 long")
