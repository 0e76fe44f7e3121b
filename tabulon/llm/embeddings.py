"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one length are turned onto the principal axes of their unit
vectors (an orthogonal map, so cosines stay), largest axis first.  They are
cut into blocks along the first axis; two blocks further apart there than unit
vectors of the wanted cosine can be are never compared.  A task compares two
blocks tile by tile: the products of the leading axes are summed first, the
rest is bounded by the product of the two suffix norms, and a tile, or the
single pairs that are left of it, goes on to further axes only while that
bound still reaches the threshold.  Sums are in single precision with a
margin; what ends within the margin of the threshold is decided in double
precision on the given components.

Equal vectors are one class, compared once.  A task returns one row per class
that has a link in it, with the number of linked vectors and the root of its
component among the two blocks, so a group of any size makes no list of pairs.

Results for odd input: a vector that is null, empty, zero, or holds null or
non-finite components links with nothing; vectors of different lengths do not
link; repeated vec_ids are vectors each; a null vec_id is no smallest id
(component_id is null only if the whole component has none); an empty table
gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces, table, written
from .components import components

THRESHOLD = 0.9
#: vectors per block, rows per tile, and the single-precision margin
BLOCK, TILE, MARGIN = 2048, 256, 1e-4
#: axes after which the bound is tried
STEPS = (4, 8, 16, 32, 64, 128, 256, 512)
#: share of a tile's pairs below which they go on one by one
SPARSE = 0.03

_ROWS = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("dim", pa.int32()), ("v", pa.list_(pa.float64()))])


def _keyed(batches):
    """vec_id, key and components of every vector; key null if it links with nothing."""
    for b in batches:
        keys, dims, vs = [], [], []
        for cell in b.column(1):
            x = cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.empty(0)
            ok = len(x) > 0 and cell.values.null_count == 0 and bool(np.isfinite(x).all()) and bool(x.any())
            x = x.astype(np.float64) + 0.0 if ok else None  # -0.0 becomes 0.0
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
            dims.append(len(x) if ok else None)
            vs.append(x)
        yield table(_ROWS, vec_id=b.column(0), key=keys, dim=dims, v=vs)


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products of the unit vectors, largest first."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def gram(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            u = _units(_matrix(b.column(0), dim))
            total += u.T @ u
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield table(schema, i=i.astype(np.int32), j=j.astype(np.int32), s=total.reshape(-1))

    sums = classes.select("v").mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # dim^2 numbers
    full = np.zeros((dim, dim))
    for r in sums:
        full[r.i, r.j] = r.s
    return np.linalg.eigh(full)[1][:, ::-1].copy()


def _pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float):
    """Index pairs of rows of a and b (components as given) with cosine >=
    threshold; a is b if ``same``, then only i < j.  ``a`` and ``b`` are
    (given, unit and turned, suffix norms per step, steps)."""
    ga, xa, na, steps = a
    gb, xb, nb, _ = b
    for lo in range(0, len(xa), TILE):
        hi = min(lo + TILE, len(xa))
        start = lo if same else 0
        left = xb[start:]
        if not len(left):
            continue
        done, dots, pairs = 0, np.zeros((hi - lo, len(left)), np.float32), None
        for k, d in enumerate(steps):
            if pairs is None:
                dots += xa[lo:hi, done:d] @ left[:, done:d].T
                keep = dots + na[lo:hi, k, None] * nb[None, start:, k] >= threshold - MARGIN
                n = int(np.count_nonzero(keep))
                if not n:
                    break
                if n <= SPARSE * keep.size or d == steps[-1]:
                    i, j = np.nonzero(keep)
                    pairs, s = (i + lo, j + start), dots[i, j]
            else:
                i, j = pairs
                s = s + np.concatenate([np.einsum("nd,nd->n", xa[i[p:p + 65536], done:d], xb[j[p:p + 65536], done:d]) for p in range(0, len(i), 65536)])
                keep = s + na[i, k] * nb[j, k] >= threshold - MARGIN
                pairs, s = (i[keep], j[keep]), s[keep]
                if not len(s):
                    break
            done = d
        else:
            i, j = pairs
            if same:
                up = i < j
                i, j, s = i[up], j[up], s[up]
            close = np.flatnonzero(s < threshold + MARGIN)
            good = np.ones(len(s), bool)
            for p in range(0, len(close), 16384):
                c = close[p:p + 16384]
                u, w = _units(ga[i[c]]), _units(gb[j[c]])
                good[c] = np.einsum("nd,nd->n", u, w) >= threshold
            yield i[good], j[good]


def _prepared(v: np.ndarray, axes: np.ndarray):
    turned = _units(v) @ axes
    steps = [s for s in STEPS if s < v.shape[1]] + [v.shape[1]]
    square = turned * turned
    suffix = np.stack([np.sqrt(square[:, s:].sum(1)) for s in steps], 1)
    return v, turned.astype(np.float32), suffix.astype(np.float32), steps


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label != label[label]).any():
        label = label[label]
    return label


_LINKS = "c long, root long, links long"


def _block_links(axes: np.ndarray, threshold: float):
    dim = len(axes)

    def compare(key, rows):
        i, j = (k.as_py() for k in key)
        order = np.argsort(rows.column("x").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        block, c, n = (rows.column(x).to_numpy() for x in ("block", "c", "n"))
        v = _matrix(rows.column("v"), dim)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a = _prepared(v[left], axes)
        b = a if i == j else _prepared(v[right], axes)
        links, ia, ib = np.zeros(len(c), np.int64), [], []
        for p, q in _pairs(a, b, i == j, threshold):
            p, q = left[p], right[q]
            links += np.bincount(p, weights=n[q], minlength=len(c)).astype(np.int64)
            links += np.bincount(q, weights=n[p], minlength=len(c)).astype(np.int64)
            ia.append(p.astype(np.int32)), ib.append(q.astype(np.int32))
        hit = np.flatnonzero(links)
        root = roots(len(c), np.concatenate(ia), np.concatenate(ib)) if len(hit) else np.empty(0, np.int64)
        return pa.table({"c": c[hit], "root": c[root[hit]] if len(hit) else np.empty(0, np.int64), "links": links[hit]})

    return compare


def class_links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """c, root, links from classes (c, n, v) of one length."""
    axes = principal_axes(classes, dim)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    schema = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("x", pa.float64()), ("v", pa.list_(pa.float64()))])

    def first_axis(batches):
        for b in batches:
            yield table(schema, c=b.column(0), n=b.column(1), x=_units(_matrix(b.column(2), dim)) @ axes[:, 0], v=b.column(2))

    rows = written(classes.select("c", "n", "v").mapInArrow(first_axis, "c long, n long, x double, v array<double>"), "vectors")
    count = pieces(rows.count(), BLOCK)
    cuts = rows.approxQuantile("x", [k / count for k in range(1, count)], 0.25 / count) if count > 1 else []

    def block_of(batches):
        for b in batches:
            at = np.searchsorted(np.array(cuts), b.column(2).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["c", "n", "x", "v", "block"])

    rows = rows.mapInArrow(block_of, "c long, n long, x double, v array<double>, block long")
    span = rows.groupBy("block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cell = lambda x: F.floor(x / reach)
    one = span.select(F.col("block").alias("i"), "lo", "hi", F.explode(F.sequence(cell(F.col("lo") - reach), cell(F.col("hi") + reach))).alias("cell"))
    two = span.select(F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    near = one.join(two, "cell").filter(F.col("i") <= F.col("j")).filter((F.col("lo2") - F.col("hi") <= reach) & (F.col("lo") - F.col("hi2") <= reach))
    near = written(near.select("i", "j").distinct(), "block-pairs")
    sides = near.select("i", "j", F.col("i").alias("block")).unionByName(near.filter("i <> j").select("i", "j", F.col("j").alias("block")))
    return rows.join(sides, "block").select("i", "j", "block", "c", "n", "x", "v").groupBy("i", "j").applyInArrow(_block_links(axes, threshold), _LINKS)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    keyed = v.mapInArrow(_keyed, "vec_id long, key binary, dim int, v array<double>")
    rows = written(keyed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.filter("key is not null").groupBy("key", "dim").agg(F.min("row").alias("c"), F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes, "vector-classes")
    links = None
    for (dim,) in classes.select("dim").distinct().collect():
        found = class_links(classes.filter(F.col("dim") == dim), dim, threshold)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = rows.sparkSession.createDataFrame([], _LINKS)
    links = written(links, "links")
    of = components(links.select(F.col("c").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("c").agg(F.sum("links").alias("links"))
    c = (classes.select("key", "c", "least", "n").join(total, "c", "left").join(of.withColumnRenamed("node", "c"), "c", "left")
         .withColumn("root", F.coalesce("root", "c")))
    least = c.groupBy("root").agg(F.min("least").alias("component_id"))
    c = c.join(least, "root").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(c, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
