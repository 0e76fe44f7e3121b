"""Best-fit packing by sums of squares.

A document's ids (an end id appended) are cut into pieces of ``capacity`` ids
only if there are more; its last piece may be shorter.  A piece goes to the
open bin, or to a new one (always, if it is full), for which the sum over all gaps g of N(g)^2 is smallest afterwards; N(g) counts
the open bins with g ids of room.  Moving a bin from gap g to gap g - s changes
the sum by 2 (N(g - s) - N(g)) + 2, closing one by 1 - 2 N(g), opening one by
2 N(capacity - s) + 1; among equals the smallest gap wins.

Pieces are dealt to shards of about ``SHARD`` documents; each shard is packed
alone, longest pieces first, by one task.  Then the bins that a shard left with
more than ``LOOSE`` of room go, as pieces of their filled length, through a
second pass over ``MERGE`` shards together.

Results for odd input: a null or empty text is one piece of the end id alone;
repeated rows are packed each; ties go by (length, row); an empty table gives
an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .common import by_key, pieces as groups_of, table, written

CAPACITY, END_ID = 2048, 0
SHARD, MERGE, LOOSE = 4096, 16, 64

_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = "row long, piece int, bin long, offset long, filled long"


def place(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, placed in the order given."""
    n = np.zeros(capacity + 1, np.int64)  # open bins per gap; index 0 stays empty
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(map(int, lengths)):
        gaps = n[s:]
        cost = 2 * (n[: capacity + 1 - s] - gaps) + 2
        cost[0] = 1 - 2 * gaps[0]
        new = 2 * n[capacity - s] + 1 if s < capacity else 0
        cost = np.where(gaps > 0, cost, np.iinfo(np.int64).max)
        best = int(np.argmin(cost))
        if cost[best] <= new:
            gap = s + best
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            n[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        cache = bpe.chunk_cache(path)
        for b in batches:
            out = []
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = bpe.encode(text.as_py(), cache) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k:k + 4 * capacity]
                    out.append((row, doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield table(_PIECE, **dict(zip(_PIECE.names, zip(*out))))

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_shard(key, rows: pa.Table, capacity: int) -> pa.Table:
    row, piece, length = (rows.column(c).to_numpy() for c in ("row", "piece", "length"))
    order = np.lexsort((piece, row, -length))
    bins, offsets = place(length[order], capacity)
    filled = np.bincount(bins, weights=length[order], minlength=0).astype(np.int64)
    return pa.table({"row": row[order], "piece": pa.array(piece[order], pa.int32()), "bin": bins, "offset": offsets, "filled": filled[bins]})


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: row, doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or bpe.default_path()
    cut = written(token_pieces(docs, path, capacity, end_id), "pieces")
    shards = groups_of(cut.count(), SHARD)
    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards))
    dealt = cut.select(shard.alias("shard"), "row", "piece", "length")

    def first(key, rows):
        out = _pack_shard(key, rows, capacity)
        return out.append_column("shard", pa.array([key[0].as_py()] * len(out), pa.int64()))

    done = written(dealt.groupBy("shard").applyInArrow(first, _PLACED + ", shard long"), "placed")
    loose = done.groupBy("shard", "bin").agg(F.first("filled").alias("length")).filter(F.col("length") < capacity - LOOSE)
    joint = loose.select(F.floor(F.col("shard") / MERGE).alias("joint"), F.col("shard").alias("row"), F.col("bin").alias("piece"), "length")

    def second(key, rows):
        return _pack_shard(key, rows, capacity).append_column("joint", pa.array([key[0].as_py()] * len(rows), pa.int64()))

    moved = joint.withColumn("piece", F.col("piece").cast("int")).groupBy("joint").applyInArrow(second, _PLACED + ", joint long")
    moved = moved.select(F.col("row").alias("shard"), F.col("piece").cast("long").alias("bin"), F.col("joint"), F.col("bin").alias("to_bin"), F.col("offset").alias("shift"))
    placed = done.join(by_key(moved), ["shard", "bin"], "left")
    # two kinds of sequence: a bin of a shard, and a joint bin of several
    seq = F.when(F.col("joint").isNotNull(), F.col("joint") * 4_294_967_296 + F.col("to_bin") * 2 + 1).otherwise(F.col("shard") * 4_294_967_296 + F.col("bin") * 2)
    at = placed.select("row", "piece", seq.alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return cut.join(by_key(at), ["row", "piece"])
