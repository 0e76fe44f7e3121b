"""Substring dedup by level-wise doubling.

A window of ``length`` words can only be repeated if the windows inside it are.
Hashes of windows are built by doubling (two overlapping windows of one length
name a window of up to twice that length), and windows are looked for level by
level: ``seed`` = half of ``length`` rounded up, then ``length``.  At the seed
level every window of ``length`` words asks for one window inside it, that with
the smallest hash, so equal windows ask for the same one and a fraction of all
are sent.  Windows whose seed no other document has are out; only the rest are
extended to twice that length (at most ``length``) and sent with their smallest
doc_id.  The search ends there, or earlier if no candidate survives.

A word is removed if a window over it also starts in a document with a smaller
id.  Windows are judged on the input, not on what is left of it.

Texts travel as batches of some MB; what is asked goes to buckets by hash, and
bits or ids come back in the same order.  A window that half of all documents
hold is one entry per batch.  Windows are told apart by 64-bit hashes of words
and windows; a pair of different windows agrees with a chance of 2^-64.

Results for odd input: a null or empty text has no words and keeps the empty
text; rows with equal ids do not remove each other's words; a null id is larger
than all others; texts shorter than a window keep all words; an empty table
gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import BUCKET_DOCS, batched, joined, packed, unpacked
from .common import drop_written, mix64, pieces, table, written
from .words import hashes, words

LENGTH = 13
#: bytes of text per batch; a task holds about thirty times that while it looks at windows
BYTES = 2_500_000
_LAST = np.iinfo(np.int64).max

_BATCH = pa.schema([("batch", pa.int64()), ("data", pa.binary())])
_ASK = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())])
_BATCH_SQL, _ASK_SQL = "batch long, data binary", "bucket long, batch long, data binary"


def lengths_up_to(length: int) -> list[int]:
    """1, ..., seed, length: each at most twice the one before."""
    out = [length]
    while out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of the seed length and of ``length`` over word
    hashes (windows that cross documents are among them)."""
    levels, seed = lengths_up_to(length), h
    for size, twice in zip(levels, levels[1:]):
        shift = twice - size
        seed, n = h, max(0, len(h) - shift)
        with np.errstate(over="ignore"):
            h = mix64(h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[shift:shift + n])
    return seed, h


class Batch:
    """Windows of one batch: word hashes, documents and window starts."""

    def __init__(self, data, length: int):
        a = unpacked(data)
        self.ids = np.where(a["known"] > 0, a["ids"], _LAST)
        self.known = a["known"] > 0
        text, ends = a["text"].tobytes(), np.cumsum(a["bytes"])
        self.words, self.starts = joined([text[e - n:e].split() for e, n in zip(ends.tolist(), a["bytes"].tolist())])
        self.length = length
        counts = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        n = len(self.words)
        seed, self.window = window_hashes(hashes(self.words), length)
        end = self.starts[1:][self.doc] if n else np.empty(0, np.int64)
        self.at = np.flatnonzero(np.arange(n) + length <= end)  # starts of windows within a document
        m = len(self.window)
        low = seed[:m].copy()
        for k in range(1, length - lengths_up_to(length)[-2] + 1 if length > 1 else 1):
            np.minimum(low, seed[k:k + m], out=low)
        self.seeds = low[self.at] if n else np.empty(0, np.uint64)
        self.window = self.window[self.at] if n else np.empty(0, np.uint64)
        self.owner = self.doc[self.at] if n else np.empty(0, np.int64)


def text_batches(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def gather(record_batches):
        for number, ids, texts in batched(record_batches, BYTES):
            raw = [t.encode() if t else b"" for t in texts]
            yield table(_BATCH, batch=[number], data=[packed(
                ids=np.array([0 if i is None else i for i in ids], np.int64), known=np.array([i is not None for i in ids], np.uint8),
                bytes=np.array([len(r) for r in raw], np.int64), text=np.frombuffer(b"".join(raw), np.uint8))])

    return written(d.mapInArrow(gather, _BATCH_SQL), "batches")


def _by_bucket(number: int, keys: np.ndarray, buckets: int, **more: np.ndarray):
    """One row per bucket with the sorted unique ``keys`` that fall into it;
    buckets are ranges of the hash, so rows are slices of the keys."""
    edges = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
    for b, (lo, hi) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])):
        if hi > lo:
            yield table(_ASK, bucket=[b], batch=[number], data=[packed(keys=keys[lo:hi], **{k: v[lo:hi] for k, v in more.items()})])


def _ask_seeds(length: int, buckets: int):
    def ask(record_batches):
        for r in record_batches:
            for number, data in zip(r.column(0).to_pylist(), r.column(1)):
                b = Batch(data.as_py(), length)
                if not len(b.seeds):
                    continue
                first = np.ones(len(b.seeds), bool)  # runs of one seed in one document count once
                first[1:] = (b.seeds[1:] != b.seeds[:-1]) | (b.owner[1:] != b.owner[:-1])
                s, d = b.seeds[first], b.owner[first]
                order = np.argsort(s, kind="stable")
                s, d = s[order], d[order]
                at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
                yield from _by_bucket(number, s[at], buckets, several=several.astype(np.uint8))
    return ask


def _answer_seeds(key, rows):
    """Which seeds occur in more than one document."""
    blocks = [unpacked(x.as_py()) for x in rows.column("data")]
    keys = np.concatenate([b["keys"] for b in blocks])
    several = np.concatenate([b["several"] for b in blocks]) > 0
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    count = np.diff(np.append(at, len(keys)))
    good = (count > 1) | np.logical_or.reduceat(several[order], at)
    bits = np.empty(len(keys), np.uint8)
    bits[order] = np.repeat(good, count)
    ends = np.cumsum([len(b["keys"]) for b in blocks])
    out = [packed(keys=b["keys"][bits[e - len(b["keys"]):e] > 0]) for b, e in zip(blocks, ends.tolist())]
    return pa.table({"bucket": rows.column("bucket"), "batch": rows.column("batch"), "data": pa.array(out, pa.binary())})


def _cells(rows) -> list[dict]:
    if not rows.num_rows:
        return []
    order = np.argsort(rows.column("bucket").to_numpy(), kind="stable")
    data = rows.column("data")
    return [unpacked(data[int(k)].as_py()) for k in order]


def _ask_windows(length: int, buckets: int):
    def ask(key, batch, answers):
        seeds = [c["keys"] for c in _cells(answers)]
        seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        out = []
        if batch.num_rows and len(seeds):
            b = Batch(batch.column("data")[0].as_py(), length)
            hit = _among(b.seeds, seeds)
            w, ids = b.window[hit], b.ids[b.owner[hit]]
            order = np.argsort(w, kind="stable")
            w, ids = w[order], ids[order]
            if len(w):
                at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                out = list(_by_bucket(key[0].as_py(), w[at], buckets, least=np.minimum.reduceat(ids, at), most=np.maximum.reduceat(ids, at)))
        return pa.Table.from_batches(out, schema=_ASK)
    return ask


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Indexes of the values that are among the sorted ``held``."""
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return np.flatnonzero(held[at] == values)


def _answer_windows(key, rows):
    """The smallest id that holds each window, where a batch has a larger one."""
    blocks = [unpacked(x.as_py()) for x in rows.column("data")]
    keys = np.concatenate([b["keys"] for b in blocks])
    ids = np.concatenate([b["least"] for b in blocks])
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(keys))))
    out, e = [], 0
    for b in blocks:
        low = least[e:e + len(b["keys"])]
        e += len(b["keys"])
        worth = low < b["most"]
        out.append(packed(keys=b["keys"][worth], least=low[worth]))
    return pa.table({"bucket": rows.column("bucket"), "batch": rows.column("batch"), "data": pa.array(out, pa.binary())})


_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])
_DONE_SQL = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"


def _remove(length: int):
    def remove(key, batch, answers):
        if not batch.num_rows:
            return _DONE.empty_table()
        b = Batch(batch.column("data")[0].as_py(), length)
        cells = _cells(answers)
        n = len(b.words)
        covered = np.zeros(n, bool)
        keys = np.concatenate([c["keys"] for c in cells]) if cells else np.empty(0, np.uint64)
        if len(keys):
            least = np.concatenate([c["least"] for c in cells])
            hit = _among(b.window, keys)
            hit = hit[least[np.searchsorted(keys, b.window[hit])] < b.ids[b.owner[hit]]]
            step = np.zeros(n + 1, np.int32)
            step[b.at[hit]] += 1
            step[b.at[hit] + length] -= 1  # no two windows start, or end, at one word
            covered = np.cumsum(step[:n]) > 0
        rows = []
        for d, (lo, hi) in enumerate(zip(b.starts[:-1].tolist(), b.starts[1:].tolist())):
            gone = covered[lo:hi]
            spans, kept = [], b.words[lo:hi]
            if gone.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()]
                kept = [w for w, g in zip(kept, gone.tolist()) if not g]
            rows.append((int(b.ids[d]) if b.known[d] else None, hi - lo, int(gone.sum()), spans, b" ".join(kept).decode()))
        return pa.Table.from_batches([table(_DONE, **dict(zip(_DONE.names, zip(*rows))))])
    return remove


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed (word
    spans), kept (the words that stay, joined by one space)."""
    buckets = pieces(docs.count(), BUCKET_DOCS)
    batches = text_batches(docs)
    seeds = written(batches.mapInArrow(_ask_seeds(length, buckets), _ASK_SQL).groupBy("bucket").applyInArrow(_answer_seeds, _ASK_SQL), "seeds")
    windows = written(batches.groupBy("batch").cogroup(seeds.groupBy("batch")).applyInArrow(_ask_windows(length, buckets), _ASK_SQL)
                      .groupBy("bucket").applyInArrow(_answer_windows, _ASK_SQL), "windows")
    drop_written(seeds)
    return batches.groupBy("batch").cogroup(windows.groupBy("batch")).applyInArrow(_remove(length), _DONE_SQL)
