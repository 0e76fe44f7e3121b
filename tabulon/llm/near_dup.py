"""MinHash near-dedup with odd sketches.

A document is the set of its distinct shingles (``width`` words, lower-cased;
a shorter text is one shingle).  Documents with equal sets are one class.  A
class has MinHash samples.  Bands of ``ROWS`` samples give the candidates.  The
first ``SAMPLES`` are folded into an odd sketch: a bitmap in which every
(sample number, value) flips one bit, so that the population count of the XOR
of two sketches estimates how many samples differ, and with it the similarity.
A candidate pair whose estimate is below the threshold by more than
five standard deviations of the estimate at the threshold (:func:`slack`) is
dropped; a link needs the exact test 100 * |A and B| >= percent * |A or B| on
the full sets.  There are as many bands as it takes that a pair at the threshold
shares none with a probability of at most ``MISSED`` (:func:`bands`): 24 at 0.85,
36 at 0.8.

Only components are wanted, so no list of pairs is made.  Classes that share
bands, directly or in chains, form a cluster; nothing outside a cluster can link
with it.  A task gets some classes of one cluster with their sketches and full
sets, confirms accepted pairs, best estimates first, as long as their ends are
not yet connected, and returns the links that connect something.  Clusters of
up to ``CHUNK`` classes are done in one such step.  Larger ones are cut into
chunks by a hash: first each chunk alone, then one class of every component
found, and last every class outside the cluster's largest component against all
chunks, which leaves no pair of different components untested.  Thousands of
near copies of a text thus cost rows in proportion to their number.

Tables of rows, classes and edges are joined by key at every size; only tables with
a row per large cluster may be sent to all tasks.

Results for odd input: a null or empty text, or one of white space alone, has
no shingles, links with nothing and is its own component; equal sets link;
repeated rows and repeated ids are documents each; a null doc_id is no smallest
id; an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import packed, unpacked
from .common import by_key, drop_written, mix64, partitions, table, written
from .components import components
from .embeddings import roots
from .words import hashes, words

#: least number of bands, samples per band, most probability to share no band
BANDS, ROWS, MISSED = 24, 5, 8e-7
#: samples of an odd sketch
SAMPLES = BANDS * ROWS
#: bits of an odd sketch
BITS = 512
#: slack at 0.85
SLACK = 0.17
#: log2 of the bits of the bitmap of wanted rows (16 MB)
MARKS = 27
CHUNK = 256
#: shingles sampled at a time, pairs tested one by one before a whole group is
#: counted at once, and columns of that count
SLAB, SINGLE, COLUMNS = 4096, 4096, 8192

_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_more = np.random.default_rng(21)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def bands(percent: int) -> int:
    """Bands such that pairs at the threshold are not missed."""
    hit = (percent / 100) ** ROWS
    return BANDS if hit >= 1 else max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-hit)))


def slack(percent: int) -> float:
    """Five standard deviations of the estimate at the threshold: of the number
    of samples that differ, and of the odd bits that their flips leave."""
    s = percent / 100
    flips = 2 * SAMPLES * (1 - s)
    odd = BITS / 4 * (1 - math.exp(-4 * flips / BITS)) - flips * math.exp(-4 * flips / BITS)
    return 5 * math.sqrt(s * (1 - s) / SAMPLES + odd / (2 * SAMPLES * math.exp(-2 * flips / BITS)) ** 2)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n samples, the same first ones for every n."""
    global _MUL, _ADD
    while len(_MUL) < n:
        a, b = _more.integers(0, 2**63, (2, SAMPLES), dtype=np.uint64)
        _MUL, _ADD = np.append(_MUL, a * np.uint64(2) + np.uint64(1)), np.append(_ADD, b)
    return _MUL[:n], _ADD[:n]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    w = hashes(words(text, lower=True))
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    h = np.full(n, len(w) if len(w) < width else width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(w))):
            h = mix64(h * _K[0] + w[k:k + n] * _K[k % 3] + np.uint64(k))
    return np.unique(h)


def samples(sets: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The first n MinHash samples of a non-empty set."""
    mul, add = _coefficients(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(sets), SLAB):
            low = np.minimum(low, (sets[k:k + SLAB, None] * mul + add).min(0))
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as uint64 words."""
    with np.errstate(over="ignore"):
        bit = (mix64(low * _K[1] + np.arange(SAMPLES, dtype=np.uint64) * _K[2]) % np.uint64(BITS)).astype(np.int64)
    parity = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def estimate(different_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    part = np.minimum(2 * different_bits / BITS, 0.999)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-part)


_SIG = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (set size), key (of the set), bands and sketch of every row."""
    n = bands(percent)

    def sign(batches):
        for b in batches:
            out = []
            for doc, text, text_hash in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                s = shingles(text.as_py(), width)
                if not len(s):
                    out.append((doc, text_hash, 0, None, None, None))
                    continue
                low = samples(s, n * ROWS)
                rows = mix64(low).reshape(n, ROWS)
                band = np.arange(n, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        band = mix64(band * _K[0] + rows[:, r])
                out.append((doc, text_hash, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band.view(np.int64), odd_sketch(low[:SAMPLES]).tobytes()))
            yield table(_SIG, **dict(zip(_SIG.names, zip(*out)))) if out else table(_SIG, **{c: [] for c in _SIG.names})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return d.mapInArrow(sign, "doc_id long, text_hash long, n long, key binary, bands array<long>, sketch binary")


def _exact(items: list[np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of full sets pass the exact test, pair by pair."""
    ok = np.empty(len(p), bool)
    for k, (i, j) in enumerate(zip(p.tolist(), q.tolist())):
        x, y = items[i], items[j]
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
    return ok


def _shared(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, as products of 0/1 columns."""
    n = np.array([len(x) for x in items])
    value, of = np.concatenate(items), np.repeat(np.arange(len(items)), n)
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1
    _, column = np.unique(column[often], return_inverse=True)
    of = of[often]
    both = np.zeros((len(items), len(items)), np.int64)
    for k in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        part = np.zeros((len(items), COLUMNS), np.float32)
        part[of[lo:hi], column[lo:hi] - k] = 1
        both += (part @ part.T).astype(np.int64)  # whole numbers up to COLUMNS
    return both


def connect(comp: np.ndarray, loose: np.ndarray, n: np.ndarray, sketch: np.ndarray, items: list[np.ndarray], percent: int, cross: bool) -> list[tuple[int, int]]:
    """Confirmed links that join different components of one group of rows;
    with ``cross`` only pairs of a loose row and another are looked at."""
    size = len(n)
    least = percent / 100 - slack(percent)
    i, j = (np.repeat(np.flatnonzero(loose), (~loose).sum()), np.tile(np.flatnonzero(~loose), loose.sum())) if cross else np.triu_indices(size, 1)
    ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))  # sizes alone can rule a pair out
    i, j = i[ok], j[ok]
    est = estimate(np.bitwise_count(sketch[i] ^ sketch[j]).sum(1)) if len(i) else np.empty(0)
    order = np.argsort(-est[est >= least], kind="stable")
    i, j = i[est >= least][order], j[est >= least][order]
    _, label = np.unique(comp, return_inverse=True)
    both, found = None, []
    while len(i):
        if both is None and len(i) > SINGLE:
            both = _shared(items)
        step = len(i) if both is not None else 64
        p, q = i[:step], j[:step]
        if both is not None:
            hit = 100 * both[p, q] >= percent * (n[p] + n[q] - both[p, q])
        else:
            hit = _exact(items, p, q, percent)
        for x, y in zip(p[hit].tolist(), q[hit].tolist()):
            if label[x] != label[y]:
                found.append((x, y))
                label[label == label[y]] = label[x]
        i, j = i[step:], j[step:]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return found


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(c: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Every row that pairs connect with a smaller one, and the first of its component."""
    x, y = np.array(pairs, np.int64).T
    label = roots(len(c), x, y)
    away = np.flatnonzero(label != np.arange(len(c)))
    return list(zip(c[away].tolist(), c[label[away]].tolist()))


def _links(rows: DataFrame, percent: int, cross: bool) -> DataFrame:
    """Connections (a, b) found in groups (g, i, j) of rows (c, comp, loose, n, sketch,
    items): of a group's own rows every row that is not the first of its
    component, and that first one; with ``cross`` pairs of components."""
    parts = rows.repartition(partitions(rows.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")

    def emit(t: pa.Table):
        key = np.stack([t.column(x).to_numpy() for x in ("g", "i", "j")], 1)
        c, comp, n = (t.column(x).to_numpy() for x in ("c", "comp", "n"))
        loose = np.array(t.column("loose").to_pylist(), bool)
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(t), -1)
        items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(key, axis=0) != 0).any(1), [True]]))
        out = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if hi - lo > 1:
                s = slice(lo, hi)
                pairs = connect(comp[s], loose[s], n[s], sketch[s], items[s], percent, cross)
                if pairs:
                    out += [(int(comp[lo + x]), int(comp[lo + y])) for x, y in pairs] if cross else _stars(c[s], pairs)
        if out:
            a, b = zip(*out)
            yield table(_PAIR, a=a, b=b)

    def work(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):  # whole groups of a few hundred rows at a time
                piece = b.slice(k, CHUNK)
                keys = np.stack([piece.column(x).to_numpy() for x in (0, 1, 2)], 1)
                change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
                if held and tuple(keys[0]) != tuple(held[-1].column(x)[held[-1].num_rows - 1].as_py() for x in (0, 1, 2)):
                    yield from emit(pa.Table.from_batches(held))
                    held = []
                cut = int(change[-1]) if len(change) else 0
                if cut:
                    yield from emit(pa.Table.from_batches([*held, piece.slice(0, cut)]))
                    held = []
                held.append(piece.slice(cut))
        if held:
            yield from emit(pa.Table.from_batches(held))

    return parts.select("g", "i", "j", "c", "comp", "loose", "n", "sketch", "items").mapInArrow(work, "a long, b long")


_SET = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("items", pa.binary())])


def _place() -> Column:
    """What tells the row that stands for a class: its id and its text, hashed."""
    return F.xxhash64(F.col("doc_id"), F.col("text_hash"))


def _bitmap(places: DataFrame) -> np.ndarray:
    """Which values of the last MARKS bits occur: always 2^MARKS bits, whatever
    the number of places, put together range by range; a range travels compressed."""
    low = MARKS - 10

    def mark(key, rows):
        at = rows.column("at").to_numpy() & ((1 << low) - 1)
        bits = np.zeros(1 << low, np.uint8)
        bits[at] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed(bits=np.packbits(bits))], pa.binary())})

    mine = places.select(F.col("at").bitwiseAND((1 << MARKS) - 1).alias("at")).distinct().withColumn("part", F.shiftright("at", low))
    out = np.zeros(1 << MARKS >> 3, np.uint8)
    for r in mine.groupBy("part").applyInArrow(mark, "part long, bits binary").collect():  # 2^10 ranges, at most about 16 KB each
        out[r.part << low >> 3:(r.part + 1) << low >> 3] = unpacked(r.bits)["bits"]
    return out


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The members (at, key, ...) with items, their whole sorted sets, from a second
    look at the texts of the rows that stand for them.  A bitmap of fixed size, made
    of these rows, keeps nearly all other texts out of the exchange, of which only
    sets are part; on so many classes that it is full it keeps out fewer, and the
    join decides alone.  Sets are dealt out once, by key and place."""
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(members))
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("text_hash")).select(_place().alias("at"), "text")

    def build(batches):
        bits = marks.value
        for b in batches:
            at = b.column(0).to_numpy()
            low = at & ((1 << MARKS) - 1)
            hit = np.flatnonzero(bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            keys, items, texts = [], [], b.column(1)
            for i in hit.tolist():
                s = shingles(texts[i].as_py(), width)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest()), items.append(s.tobytes())
            yield table(_SET, key=keys, at=at[hit], items=items)

    found = d.mapInArrow(build, "key binary, at long, items binary")
    return found.join(by_key(members), ["key", "at"]).dropDuplicates(["key", "at"]).drop("key", "at")


def _chunked(members: DataFrame) -> DataFrame:
    """Members (g, c, ...) with the size of their cluster and their chunk of it;
    only large clusters, of which there are few, are joined."""
    size = members.groupBy("g").agg(F.count("*").alias("size")).filter(F.col("size") > CHUNK)
    rows = members.join(size, "g", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("c"), F.greatest(F.ceil(F.col("size") / CHUNK), F.lit(1))))


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the members (g, c, size, chunk, n, sketch, items) that are not
    the root of their component under all links; a root has no row.

    Chunks and groups of heads are disjoint, so what they find are labels at
    once; only the last step, between components, needs rounds."""
    none = F.lit(0).cast("long")
    sets = by_key(members.select("c", "n", "sketch", "items"))
    alone = members.select("*", F.col("c").alias("comp"), F.lit(False).alias("loose"), F.col("chunk").alias("i"), F.col("chunk").alias("j"))
    first = written(_links(alone, percent, False), "links").select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = members.filter(F.col("size") > CHUNK).select("g", "c", "chunk", "size")
    if large.isEmpty():
        return first
    large = large.join(by_key(first), F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "c")).drop("node", "root")
    # one class of every component of a chunk
    heads = large.filter("c = comp")
    n = heads.groupBy("g").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    heads = heads.join(n, "g").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "c"), F.col("parts"))).withColumn("j", F.col("i"))
    second = written(_links(heads.withColumn("loose", F.lit(False)).join(sets, "c"), percent, False), "links")
    now = large.join(by_key(second), F.col("comp") == F.col("a"), "left").withColumn("comp", F.coalesce("b", "comp")).drop("a", "b")
    now = written(now.select("g", "c", "chunk", "size", "comp"), "labels")
    # what is outside the largest component, against everything
    per = now.groupBy("g", "comp").agg(F.count("*").alias("n"))
    top = per.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("t"), F.sum("n").alias("all")).select("g", F.col("t.comp").alias("top"), (F.col("all") - F.col("t.n")).alias("outside"))
    rest = now.join(by_key(written(top.filter("outside > 0"), "tops")), "g")
    parts = F.ceil(F.col("outside") / CHUNK)
    loose = rest.filter("comp <> top").withColumn("i", F.pmod(F.xxhash64(F.lit(2), "c"), parts)).withColumn("j", F.explode(F.sequence(none, F.ceil(F.col("size") / CHUNK) - 1)))
    others = rest.withColumn("i", F.explode(F.sequence(none, parts - 1))).withColumn("j", F.col("chunk"))
    both = loose.withColumn("loose", F.lit(True)).unionByName(others.withColumn("loose", F.lit(False))).select("g", "i", "j", "c", "comp", "loose")
    third = written(_links(both.join(sets, "c"), percent, True), "links")
    if not third.isEmpty():
        now = now.join(by_key(written(components(third), "components")), F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "comp"))
    small = members.filter(F.col("size") <= CHUNK).select(F.col("c").alias("node")).join(by_key(first), "node")
    return small.unionByName(now.filter("c <> comp").select(F.col("c").alias("node"), F.col("comp").alias("root")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, row, text_hash, n_shingles,
    component (a number of its own), component_id (its smallest doc_id), kept."""
    spark = docs.sparkSession
    rows = written(signatures(docs, width, percent).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = (rows.filter("n > 0").groupBy("key").agg(F.min("row").alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    classes = classes.select("key", "c", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"), "n", "sketch", "bands")
    classes = written(classes.select("key", "c", F.col("doc_id").alias("least"), _place().alias("at"), "n", "sketch", "bands"), "classes")
    bands = classes.select("c", F.posexplode("bands").alias("k", "v")).select("c", F.xxhash64("k", "v").alias("band"))
    many = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("c").alias("first")).filter("size > 1")
    stars = bands.join(by_key(many), "band").select(F.col("c").alias("a"), F.col("first").alias("b"))
    cluster = components(stars)
    g = cluster.unionByName(cluster.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("c"), F.col("root").alias("g"))
    members = written(_chunked(classes.select("c", "at", "key", "n", "sketch").join(by_key(g), "c")), "clusters")
    whole = written(_with_sets(docs, members, width), "members")
    drop_written(members)
    of = written(_confirmed(whole, percent), "components")
    drop_written(whole)
    c = classes.select("key", "c", "least").join(by_key(of.withColumnRenamed("node", "c")), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = c.groupBy("root").agg(F.min("least").alias("component_id"))
    c = c.join(by_key(least), "root").select("key", "root", "component_id")
    out = rows.select("doc_id", "row", "text_hash", "key", F.col("n").alias("n_shingles")).join(by_key(c), "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row", "text_hash", "n_shingles", F.coalesce("root", "row").alias("component"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays in each component, that with
    the smallest doc_id; rows equal in id and text are one document.  All
    columns are kept."""
    found = near_duplicates(docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("w")
    win = found.groupBy("component").agg(first).groupBy(F.col("w.doc_id").alias("__tb_doc"), F.col("w.text_hash").alias("__tb_hash")).agg(F.lit(1).alias("__tb_one"))
    same = found.groupBy(F.col("doc_id").alias("d2"), F.col("text_hash").alias("h2")).agg(F.count("*").alias("__tb_same"))
    win = written(win.join(by_key(same), F.col("__tb_doc").eqNullSafe(F.col("d2")) & (F.col("__tb_hash") == F.col("h2"))).select("__tb_doc", "__tb_hash", "__tb_same"), "winners")
    hit = docs.withColumn("__tb_mine", F.xxhash64("text")).join(by_key(win), F.col("doc_id").cast("long").eqNullSafe(F.col("__tb_doc")) & (F.col("__tb_mine") == F.col("__tb_hash")))
    once, again = hit.filter("__tb_same = 1"), hit.filter("__tb_same > 1").dropDuplicates(["__tb_doc", "__tb_hash"])
    return once.unionByName(again).select(*docs.columns)
