"""Token ids in bit-packed files.

Format (all integers little-endian):

    magic     8 bytes  "TBPACK01"
    bits      uint32   bits per id, the fewest that hold the largest vocabulary id
    block     uint32   ids per block (a multiple of 8)
    n_docs    uint64
    n_ids     uint64
    first     uint64   number of ids of all files before this one
    doc ids   int64[n_docs], then a null mask uint8[n_docs]
    doc ends  uint64[n_docs]      ids up to the end of each document, in this file
    offsets   uint64[n_blocks + 1]  byte offset of every block within the data
    data      blocks; an id's lowest bit comes first, a block ends on a byte

A reader gets any document by its ends and the offsets of the blocks it lies
in; blocks unpack by whole-array numpy operations, eight ids at a time, since
eight ids of b bits always fill b bytes.

Files hold documents in ascending (doc_id, text) order.  ``first`` needs the
counts of earlier files, so files are written with first = 0 and a catalogue
of the files carries it; a file is a few MB and is written under a temporary
name and renamed, so a task that runs twice leaves one whole file.

Results for odd input: a null or empty text is the end id alone; a null doc_id
comes first; repeated rows are documents each; an empty table writes no file
and gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bpe
from .common import partitions, shared_folder, table, written

MAGIC, BLOCK, END_ID, VOCABULARY = b"TBPACK01", 4096, 1, 49408
FILE_IDS = 4_000_000
_HEAD = struct.Struct("<8sIIQQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing; pads with zero ids to a multiple of eight."""
    ids = np.concatenate([ids, np.zeros(-len(ids) % 8, ids.dtype)]).astype(np.uint64).reshape(-1, 8)
    out = np.zeros((len(ids), bits + 8), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        v = ids[:, j] << np.uint64(shift)
        for k in range((bits + shift + 7) // 8):
            out[:, byte + k] |= ((v >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack_bits(data, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as uint32."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.empty((len(raw), 8), np.uint32)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        v = np.zeros(len(raw), np.uint64)
        for k in range((bits + shift + 7) // 8):
            v |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (v >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK, first: int = 0) -> bytes:
    blocks = [pack_bits(ids[k:k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    head = _HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), first)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, names.tobytes(), known.tobytes(), np.cumsum(counts).astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, n, self.n_ids, self.first = _HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = _HEAD.size
        names = np.frombuffer(self.data, "<i8", n, at)
        known = np.frombuffer(self.data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known)]
        self.ends = np.frombuffer(self.data, "<u8", n, at + 9 * n)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at + 17 * n)
        self.start = at + 17 * n + 8 * (n_blocks + 1)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of the file, reading only the blocks they lie in."""
        if hi <= lo:
            return np.empty(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block + 1
        raw = self.data[self.start + int(self.offsets[a]):self.start + int(self.offsets[b])]
        n = min(self.n_ids, b * self.block) - a * self.block
        return unpack_bits(raw, n, self.bits)[lo - a * self.block:hi - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a whole file into a shared folder under its final name at once."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        store, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    else:
        store, path = fs.LocalFileSystem(), folder
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


_DONE = pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_ids", pa.int64())])


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, vocabulary: int = VOCABULARY) -> DataFrame:
    """Encode every document and write the files; returns their catalogue:
    file, first (ids of all files before it), n_ids, in doc_id order."""
    path, bits = path or bpe.default_path(), bits_for(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ranges of doc_id alone: the sample that finds them holds its sort keys, and must not hold texts
    d = d.repartitionByRange(partitions(docs.sparkSession, 8), F.col("doc_id").asc_nulls_first())
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).withColumn("part", F.spark_partition_id())

    def write(batches):
        cache = bpe.chunk_cache(path)
        names, parts, size, part, k = [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"tokens-{part:06d}-{k:05d}.tbp"
            put_file(folder, name, file_bytes(names, np.array([len(p) // 4 for p in parts]), ids, bits))
            return table(_DONE, file=[name], part=[(part << 32) + k], n_ids=[len(ids)])

        for b in batches:
            for doc, text, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                ids = bpe.encode(text.as_py(), cache) + end
                names.append(doc), parts.append(ids)
                size, part = size + len(ids) // 4, p
                if size >= FILE_IDS:
                    yield flush()
                    names, parts, size, k = [], [], 0, k + 1
        if names:
            yield flush()

    done = written(d.mapInArrow(write, "file string, part long, n_ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return done.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"), "n_ids")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_files(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The files are listed and read by Spark; those that the catalogue does not
    name (left by a task that was given up) are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tbp").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(catalogue, "file")  # a small catalogue is broadcast by its size, as Spark sees it

    def read(batches):
        for b in batches:
            for data, first in zip(b.column(0), b.column(1).to_pylist()):
                f = PackedFile(data.as_buffer())
                ends = [int(e) for e in f.ends]
                starts = [0, *ends[:-1]]
                step = 512  # documents whose blocks are unpacked at once
                crcs = []
                for k in range(0, len(ends), step):
                    lo = starts[k]
                    ids = f.ids(lo, ends[min(k + step, len(ends)) - 1]).astype("<u4")
                    crcs += [zlib.crc32(ids[s - lo:e - lo]) for s, e in zip(starts[k:k + step], ends[k:k + step])]
                yield table(_READ, doc_id=f.doc_ids, start=[first + s for s in starts], n_tokens=[e - s for s, e in zip(starts, ends)], ids_crc32=crcs)

    return named.select("content", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files of ``docs`` into the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    catalogue = write_files(docs, folder, path)
    return read_files(spark, folder, catalogue)
