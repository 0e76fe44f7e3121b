"""Batches of documents, and arrays packed into cells.

A batch is some thousand consecutive documents of one partition, a few MB of
text; its number is the partition's and a count.  Batches let numpy work on
long arrays and let a shuffle carry one packed row per batch and bucket instead
of one row per word.  The number of buckets grows with the documents, so a
bucket stays a few MB; on a very large corpus a row carries few words, and the
exchange becomes an ordinary shuffle by key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: documents and bytes of text per batch, documents per bucket
DOCS, BYTES, BUCKET_DOCS = 4096, 4_000_000, 4096


def batched(record_batches: Iterable[pa.RecordBatch], most: int = BYTES) -> Iterator[tuple[int, list, list]]:
    """(number, ids, texts) for batches of rows (doc_id, text) of about ``most`` bytes."""
    part = TaskContext.get().partitionId()
    k, ids, texts, size = 0, [], [], 0
    for b in record_batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            ids.append(doc), texts.append(t)
            size += len(t) if t else 0
            if len(ids) >= DOCS or size >= most:
                yield (part << 24) + k, ids, texts
                k, ids, texts, size = k + 1, [], [], 0
    if ids:
        yield (part << 24) + k, ids, texts


def packed(**arrays: np.ndarray) -> bytes:
    """Named arrays as compressed bytes."""
    parts = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head = f"{name} {a.dtype.str} {len(a)}".encode()
        parts += [len(head).to_bytes(2, "little"), head, a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    out, at = {}, 0
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 2], "little")
        name, kind, size = raw[at + 2:at + 2 + n].decode().split()
        dtype = np.dtype(kind)
        at += 2 + n
        out[name] = np.frombuffer(raw, dtype, int(size), at)
        at += int(size) * dtype.itemsize
    return out


def joined(lists: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words of a batch in one list, and where each document begins."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    return [w for x in lists for w in x], starts
