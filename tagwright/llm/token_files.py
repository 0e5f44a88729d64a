"""Operator 6 - token ids in dictionary-compressed files.

Documents are range-partitioned and sorted by doc_id, encoded, and packed into
blocks of about ``BLOCK_BYTES``. A block is one binary value of our own layout
and holds consecutive documents; blocks are rows of a Parquet table, so any
store Spark can write to will do:

    magic 'TWTB' | version u16 | id width u16 | documents u32 | SHA-256 of the dictionary (32)
    offsets u64 x (documents + 1), into the frames | id counts u64 x documents
    frames: per document one zstandard frame of its ids, made with the shared dictionary

A short document is read by itself: prune blocks by first_doc/last_doc, take
two offsets, and decompress one frame with the dictionary whose hash the block
names. The files are two tables under one path, ``blocks`` and ``dictionary`` (its hash and its bytes), so that
``open_files`` needs nothing but the path.

The dictionary is trained on the serialized id arrays of at most
``SAMPLE_DOCS`` documents (those whose doc_id has the smallest hash; of a text of more than ``SAMPLE_CHARS``
characters so many, from a place set by that hash): a compression aid, which never changes the ids read back.
Where zstandard can't train on so little, the sample itself is the dictionary (as raw content), and
without any sample the serialized ids 0 to 255 are: a dictionary there always is.

Ids are little-endian, 16 bits wide while the vocabulary allows, else 32.

Defined cases: NULL and empty texts hold the end id alone; equal doc_ids keep
separate entries in the order of their text; NULL doc_ids come first; an
empty table gives an empty one; very long texts are one frame and close their block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import fresh_path, slim_batches, smallest_hashes, table, tidy
from .tokens import encoder, tokenizer_path

BLOCK_BYTES = 1 << 20
SAMPLE_DOCS = 800
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
END_ID = 0
_HEAD = struct.Struct("<4sHHI32s")
BLOCK_SCHEMA = "part int, block int, first_doc long, last_doc long, n_ids long, doc_ids array<long>, payload binary"


class TokenFiles(NamedTuple):
    """The files under a path: the table of blocks, and the dictionary they name."""

    path: str
    blocks: DataFrame
    dictionary: bytes


def id_width(path: str) -> int:
    return 2 if encoder(path).library.get_vocab_size() <= 1 << 16 else 4


def pack_block(frames: list[bytes], counts: list[int], width: int, dictionary_hash: bytes) -> bytes:
    offsets = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    head = _HEAD.pack(b"TWTB", 1, width, len(frames), dictionary_hash)
    return b"".join([head, offsets.tobytes(), np.array(counts, "<u8").tobytes(), *frames])


class Block:
    """Random access to the documents of a block."""

    def __init__(self, payload: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, self.n, digest = _HEAD.unpack_from(payload)
        if magic != b"TWTB" or version != 1:
            raise ValueError("not a token block")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        self.offsets = np.frombuffer(payload, "<u8", self.n + 1, at)
        self.counts = np.frombuffer(payload, "<u8", self.n, at + 8 * (self.n + 1))
        self.base, self.payload = at + 8 * (2 * self.n + 1), memoryview(payload)
        data = zstandard.ZstdCompressionDict(dictionary)
        self.reader = zstandard.ZstdDecompressor(dict_data=data)

    def ids(self, i: int) -> np.ndarray:
        frame = self.payload[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]
        raw = self.reader.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """The shared dictionary, never empty; a trained one starts with zstandard's magic number, any other is raw content."""
    h = F.xxhash64("doc_id")
    place = F.pmod(h, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = smallest_hashes(docs, SAMPLE_DOCS, F.col("text").isNotNull()).select(F.col("text").substr(place, F.lit(SAMPLE_CHARS)).alias("text"))
    enc, width = encoder(path), id_width(path)
    rows = [enc.whole(r["text"]).astype(f"<u{width}").tobytes() for r in texts.collect()]  # SAMPLE_DOCS at most, of SAMPLE_CHARS
    return dictionary_of([r for r in rows if r], width)


def dictionary_of(rows: list[bytes], width: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, rows)) // 4), rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(rows)[:DICTIONARY_BYTES] or np.arange(256).astype(f"<u{width}").tobytes()


def open_files(spark: SparkSession, path: str) -> TokenFiles:
    """Files that ``write`` has left under ``path``, in this session or another."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["bytes"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return TokenFiles(path, spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks"), bytes(row["bytes"]))


def write(docs: DataFrame, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", path: str | None = None) -> TokenFiles:
    """Encode every text of docs(doc_id, text), append ``end_id``, and write the files in doc_id order under ``path`` (a fresh shared folder if there is none)."""
    spark, vocabulary = docs.sparkSession, tokenizer_path(tokenizer)
    path = path or fresh_path(spark, "token-files")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, vocabulary)
    digest, width = hashlib.sha256(dictionary).digest(), id_width(vocabulary)
    stored = spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, bytes binary")
    stored.coalesce(1).write.parquet(f"{path}/dictionary")
    kept = docs.sparkSession.sparkContext.broadcast(dictionary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc = encoder(tokenizer_path(tokenizer))
        data = zstandard.ZstdCompressionDict(kept.value)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([min(known, default=None)], pa.int64()),
                 pa.array([max(known, default=None)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([pack_block(frames, counts, width, digest)], pa.binary())],
                names=["part", "block", "first_doc", "last_doc", "n_ids", "doc_ids", "payload"],
            )

        end = np.array([end_id], f"<u{width}").tobytes()
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                found, at = enc.encode_part(buf, offsets)
                found = found.astype(f"<u{width}")
                for i in range(lo, hi):
                    raw = found[at[i - lo] : at[i - lo + 1]].tobytes() + end
                    frame = press.compress(raw)
                    ids.append(doc_ids[i])
                    frames.append(frame)
                    counts.append(len(raw) // width)
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield close()
                        ids, frames, counts, size, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(blocks), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    return open_files(spark, path)


def read(files: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id, part, block, place (in its block), n_tokens, ids_crc32."""
    kept = files.blocks.sparkSession.sparkContext.broadcast(files.dictionary)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, doc_ids, payload in zip(*(b.column(c) for c in ("part", "block", "doc_ids", "payload")), strict=True):
                block, doc_ids = Block(payload.as_py(), kept.value), doc_ids.as_py()
                crc = [zlib.crc32(block.ids(i).tobytes()) for i in range(block.n)]
                k = len(doc_ids)
                before = np.cumsum(block.counts.astype(np.int64)) - block.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([part.as_py()] * k, pa.int32()), pa.array([number.as_py()] * k, pa.int32()),
                     pa.array(range(k), pa.int32()), pa.array(before, pa.int64()), pa.array(block.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "block", "place", "before", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id long, part int, block int, place int, before long, n_tokens long, ids_crc32 long"
    return files.blocks.select("part", "block", "doc_ids", "payload").mapInArrow(tidy(documents), schema)


def with_starts(files: TokenFiles) -> DataFrame:
    """``read`` with ``start``: the ids of all documents before each.

    Only block totals are summed over the whole table: partition totals in one
    row per partition, block totals within their partition.
    """
    from pyspark.sql import Window

    per_part = files.blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = per_part.withColumn("part_start", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        files.blocks.select("part", "block", F.coalesce(inside, F.lit(0)).alias("block_start"))
        .join(whole.select("part", F.coalesce("part_start", F.lit(0)).alias("part_start")), "part")
        .select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    )
    return read(files).join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim_batches(spark)
    return with_starts(write(table(spark, sf_dir, "documents")))
