"""Exact dedup against a history, through minimal perfect hashing.

The distinct SHA-256 digests of the history are hashed into buckets.  In each
bucket a minimal perfect hash (levels of bit arrays, where a key leaves at the
first level at which it has a bit to itself; its slot is the rank of that bit)
gives every digest its own slot, which holds the whole 32-byte digest and the
winner's locator (doc_id, row) with the number of copies.  A digest of the
current rows is looked up: all 32 bytes of its slot must agree, else it is no
member and is grouped apart.  Rows are counted per digest before any of this,
so that a group of copies of any size is one entry.

Results for odd input: a null text equals the empty text; a null doc_id is
smaller than any other; of repeated rows (same doc_id and text) one stays; an
empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_key, mix64, pieces, written

#: distinct digests per bucket; a bucket is built and searched by one task
BUCKET = 2048
#: bits per key and level, and levels of the hash
GAMMA, LEVELS = 2, 40

CLASS_SCHEMA = "digest binary, win_doc long, win_row long, n long"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix64(words[:, level % 4] ^ (words[:, (level + 1) % 4] << np.uint64(1)) ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: ``slots`` maps the
    n keys onto 0..n-1; a key that is none of them gets some slot or -1."""

    def __init__(self, digests: list[bytes]):
        self.levels: list[np.ndarray] = []
        words = _words(digests)
        rest = np.arange(len(digests))
        for level in range(LEVELS):
            if not len(rest):
                break
            size = GAMMA * len(rest)
            pos = _positions(words[rest], level, size)
            bits = np.bincount(pos, minlength=size) == 1
            self.levels.append(bits)
            rest = rest[~bits[pos]]
        self.base = np.cumsum([0] + [int(b.sum()) for b in self.levels])
        self.ranks = [np.cumsum(b) - b for b in self.levels]
        #: keys that no level could part (not seen in practice) are kept in a list at the end
        self.last = {digests[i]: int(self.base[-1]) + k for k, i in enumerate(rest)}

    def slots(self, digests: list[bytes]) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        words = _words(digests)
        rest = np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            pos = _positions(words[rest], level, len(bits))
            hit = bits[pos]
            out[rest[hit]] = self.base[level] + self.ranks[level][pos[hit]]
            rest = rest[~hit]
        for i in rest:
            out[i] = self.last.get(digests[i], -1)
        return out


def _later(a: tuple, b: tuple) -> tuple:
    key = lambda w: (w[0] is not None, w[0] or 0, w[1])
    return max(a, b, key=key)


def _merge(key, rows):
    """One bucket: index the history, look the current digests up, and return
    the classes of both."""
    digest, doc, row, n, old = (rows.column(c).to_pylist() for c in ("digest", "win_doc", "win_row", "n", "old"))
    history = [i for i, o in enumerate(old) if o]
    asked = [i for i, o in enumerate(old) if not o]
    index = PerfectHash([digest[i] for i in history])
    slot_digest: list = [None] * len(history)
    slot_win: list = [None] * len(history)
    slot_n = [0] * len(history)
    for s, i in zip(index.slots([digest[i] for i in history]), history):
        slot_digest[s], slot_win[s], slot_n[s] = digest[i], (doc[i], row[i]), n[i]
    apart: list[tuple] = []
    for s, i in zip(index.slots([digest[i] for i in asked]), asked):
        if s >= 0 and slot_digest[s] == digest[i]:
            slot_win[s], slot_n[s] = _later(slot_win[s], (doc[i], row[i])), slot_n[s] + n[i]
        else:
            apart.append((digest[i], doc[i], row[i], n[i]))
    rows = [(d, w[0], w[1], n) for d, w, n in zip(slot_digest, slot_win, slot_n)] + apart
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    names=["digest", "win_doc", "win_row", "n"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for every row) and digest, written once."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    return written(d.withColumn("row", F.monotonically_increasing_id()), "digests")


def classes(rows: DataFrame, is_history) -> DataFrame:
    """One row per distinct digest of ``rows`` (doc_id, row, digest): the
    winner's doc_id and row, and the number of copies.  ``is_history`` is the
    condition that marks the rows of the history."""
    n = rows.count()
    per = (rows.groupBy("digest", F.coalesce(is_history, F.lit(False)).alias("old"))
           .agg(F.max(F.struct("doc_id", "row")).alias("w"), F.count("*").alias("n"))
           .select("digest", "old", F.col("w.doc_id").alias("win_doc"), F.col("w.row").alias("win_row"), "n",
                   F.pmod(F.xxhash64("digest"), F.lit(pieces(n, BUCKET))).alias("bucket")))
    return written(per.groupBy("bucket").applyInArrow(_merge, CLASS_SCHEMA), "classes")


def older_half(rows: DataFrame):
    """The history of a table that has none of its own: ids up to the middle
    of the id range (it decides who is looked up, never the result)."""
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= (0 if lo is None else (lo + hi) // 2)


def exact_dedup(docs: DataFrame, history=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, keep_id, group_size, kept, text_sha256.

    ``history`` is a condition on (doc_id, row, digest) that marks the
    historical rows; by default the older half of the ids."""
    rows = digests(docs)
    found = classes(rows, older_half(rows) if history is None else history)
    return (rows.join(found, "digest")
            .select("doc_id", "row", F.col("win_doc").alias("keep_id"), F.col("n").alias("group_size"),
                    (F.col("row") == F.col("win_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without repeats of a text: of equal texts the
    largest doc_id stays.  All columns are kept."""
    rows = digests(docs)
    found = classes(rows, older_half(rows))
    mine = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    # a winner is found by (digest, doc_id); where that pair repeats, one row of it stays
    pairs = rows.join(by_key(found.select(F.col("digest").alias("d2"), "win_doc")), (F.col("digest") == F.col("d2")) & F.col("doc_id").eqNullSafe(F.col("win_doc")))
    win = written(pairs.groupBy("digest", "win_doc").agg(F.count("*").alias("same")).select(F.col("digest").alias("__tb_digest"), F.col("win_doc").alias("__tb_doc"), F.col("same").alias("__tb_same")), "winners")
    hit = docs.withColumn("__tb_mine", mine).join(by_key(win), (F.col("__tb_mine") == F.col("__tb_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__tb_doc")))
    once = hit.filter("__tb_same = 1")
    again = hit.filter("__tb_same > 1").dropDuplicates(["__tb_mine"])
    return once.unionByName(again).select(*docs.columns)
