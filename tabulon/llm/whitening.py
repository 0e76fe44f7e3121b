"""Whitening of embeddings: quantised vectors, their distributed covariance, and
eigenvectors brought from single to double precision by matrix products.

Every component c becomes the whole number x = floor(64 c) + 1,000,000.  The
distinct x vectors are the fit list; its sums are added exactly, and its
covariance from vectors centred first, so the large offset cancels without loss.
Tasks add up their own rows and a tree of small sums joins them, so neither a
task nor the driver ever holds more than a few matrices.

The matrix's eigenvectors are computed in float32 and then corrected in float64
by Ogita and Aishima's iteration, which consists of matrix products alone and
doubles the right digits each time.  Eigenvalues closer than its error bound
form a cluster; within one the iteration only restores orthogonality, and the
matrix restricted to the cluster, shifted by its mean and scaled up, is solved
in the same way, as deep as double precision reaches.

Results for odd input: a vector that is null, empty, or holds null or non-finite
components, or one that does not fit a 64-bit x, is dropped; vectors of
different lengths have models of their own; repeated vec_ids and null vec_ids
are vectors each; equal vectors count once in the fit; a component whose
eigenvalue is not above rounding error (fewer distinct vectors than dimensions,
constant dimensions) has whitened null, and explained is null where the trace is
0; identity_error covers the other components, null without any; an empty table
gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import drop_written, table, written

SCALE, OFFSET = 64.0, 1_000_000
#: components returned, matrices added by one task, rounds of the iteration
COMPONENTS, FAN, ROUNDS = 16, 16, 12
EPS = np.finfo(np.float64).eps


# ------------------------------------------------------------ eigenvectors

def _clusters(lam: np.ndarray, delta: float) -> list[np.ndarray]:
    """Groups of at least two eigenvalues, each within delta of the next."""
    order = np.argsort(lam)
    cuts = np.flatnonzero(np.diff(lam[order]) > delta) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _corrected(a: np.ndarray, x: np.ndarray, norm: float):
    """One Ogita-Aishima step: better eigenvectors, their Rayleigh quotients, the
    distance below which two of them count as one, and the largest correction."""
    r = np.eye(len(x)) - x.T @ x
    s = x.T @ (a @ x)
    lam = np.diag(s) / (1 - np.diag(r))
    delta = 2 * (np.linalg.norm(s - np.diag(lam), 2) + norm * np.linalg.norm(r, 2))
    gap = lam[None, :] - lam[:, None]
    apart = np.abs(gap) > delta
    e = np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
    return x + x @ e, lam, delta, np.abs(e).max()


def eigenvectors(a: np.ndarray, floor: float | None = None) -> np.ndarray:
    """Orthonormal eigenvectors of the symmetric matrix ``a`` (columns, no order)
    to double precision.  ``floor``: what is rounding error in ``a``."""
    n, top = len(a), np.abs(a).max(initial=0.0)
    floor = n * EPS * top if floor is None else floor
    if n < 2 or top <= floor:  # nothing but rounding: every basis will do
        return np.eye(n)
    a, floor = a / top, floor / top
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    norm = np.linalg.norm(a, 2)
    for _ in range(ROUNDS):
        x, lam, delta, change = _corrected(a, x, norm)
        if change < 4 * EPS * n:
            break
        if change < 1e-6:  # the spaces of the clusters are settled
            for g in _clusters(lam, delta):
                part = x[:, g]
                inner = part.T @ (a @ part)
                inner = (inner + inner.T) / 2 - np.eye(len(g)) * lam[g].mean()
                x[:, g] = part @ eigenvectors(inner, max(floor, n * EPS))
    for _ in range(2):  # a last correction over a small gap may leave them skew
        x = x + x @ (np.eye(n) - x.T @ x) / 2
    return x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix."""
    x = eigenvectors((a + a.T) / 2)
    x = x / np.sqrt((x * x).sum(0))
    lam = (x * (a @ x)).sum(0)
    order = np.argsort(-lam, kind="stable")
    return lam[order], x[:, order]


# ------------------------------------------------------------ vectors

def _vectors(batch: pa.RecordBatch):
    """Row numbers and whole numbers d = floor(64 c) of the vectors of each length."""
    column = batch.column(1)
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE
    ends = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0 ** 62))])  # also NaN
    ok = (length > 0) & (bad[ends] == bad[ends - length])
    for dim in np.unique(length[ok]):
        at = np.flatnonzero(ok & (length == dim))
        yield at, np.floor(flat[(ends[at] - dim)[:, None] + np.arange(dim)]).astype(np.int64)


def _keys(batches):
    """Vectors as bytes: the width of a component, then the components."""
    schema = pa.schema([("dim", pa.int32()), ("x", pa.binary())])
    for b in batches:
        for _, d in _vectors(b):
            size = np.abs(d).max(1)
            width = 1 << np.searchsorted([2 ** 7, 2 ** 15, 2 ** 31], size, "right")
            for w in np.unique(width):
                rows = np.ascontiguousarray(d[width == w].astype(f"<i{w}"))
                yield table(schema, dim=np.full(len(rows), d.shape[1], np.int32), x=[bytes([w]) + r.tobytes() for r in rows])


def _unpacked(cells, dim: int) -> np.ndarray:
    raw = [c.as_py() for c in cells]
    out = np.empty((len(raw), dim), np.int64)
    width = np.array([r[0] for r in raw])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(raw[i][1:] for i in at), f"<i{w}").reshape(-1, dim)
    return out


def _by_length(batches):
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims):
            yield int(dim), _unpacked(b.column(1).take(pa.array(np.flatnonzero(dims == dim))), int(dim))


def _exact_sum(m: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    return m.sum(0).astype(object) if np.abs(m).max(initial=0) < 2 ** 40 else m.astype(object).sum(0)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: number of distinct vectors and exact sums of d."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.decimal128(38, 0)))])

    def add(batches):
        total: dict = {}
        for dim, d in _by_length(batches):
            n, s = total.get(dim, (0, 0))
            total[dim] = n + len(d), s + _exact_sum(d)
        yield table(schema, dim=list(total), n=[n for n, _ in total.values()], s=[[Decimal(v) for v in s] for _, s in total.values()])

    parts = fit.mapInArrow(add, "dim int, n long, s array<decimal(38,0)>")
    out = parts.select("dim", "n", F.posexplode("s").alias("i", "s")).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict = {}
    for r in out.orderBy("dim", "i").collect():  # one row per dimension
        found.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return found


class Model:
    """Centre, components and scales for vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dim = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)  # of the mean of d
        self.rest = [s - n * (s // n) for s in sums]             # sum of d - whole
        self.part = np.array([r / n for r in self.rest])
        self.axes, self.explained, self.identity_error = np.zeros((self.dim, 0)), [], None

    def fit(self, covariance: np.ndarray) -> None:
        lam, x = eigen(covariance)
        trace, k = np.trace(covariance), min(COMPONENTS, self.dim)
        good = lam[:k] > self.dim * EPS * max(lam[0], 0.0)
        self.axes = np.where(good, x[:, :k] / np.sqrt(np.where(good, lam[:k], 1.0)), np.nan)
        self.explained = [float(v / trace) if trace > 0 else None for v in lam[:k]]

    def centred(self, d: np.ndarray) -> np.ndarray:
        return (d - self.whole).astype(np.float64) - self.part

    def whitened(self, d: np.ndarray) -> np.ndarray:
        return self.centred(d) @ self.axes

    def deviation(self, d: np.ndarray) -> pa.Array:
        """Exact sum of (n x - S)^2, null from 10^38."""
        q = d - self.whole
        if (self.n * (int(np.abs(q).max(initial=0)) + 1)) ** 2 * self.dim < 2 ** 62:
            v = self.n * q - np.array(self.rest, np.int64)
            return pa.array((v * v).sum(1), pa.int64()).cast(pa.decimal128(38, 0), safe=False)
        v = (self.n * q.astype(object) - np.array(self.rest, object))
        return pa.array([Decimal(s) if s < 10 ** 38 else None for s in (v * v).sum(1)], pa.decimal128(38, 0))


_PART = "dim int, slot long, g array<double>"


def _products(fit: DataFrame, models: dict[int, Model], of) -> dict[int, np.ndarray]:
    """Per length the sum over the fit list of m'm, m = of(model, d)."""
    schema = pa.schema([("dim", pa.int32()), ("slot", pa.int64()), ("g", pa.list_(pa.float64()))])

    def own(batches):
        total: dict = {}
        for dim, d in _by_length(batches):
            m = of(models[dim], d)
            total[dim] = total.get(dim, 0.0) + m.T @ m
        slot = TaskContext.get().partitionId()
        yield table(schema, dim=list(total), slot=[slot] * len(total), g=[g.reshape(-1) for g in total.values()])

    def add(key, parts):
        g = np.add.reduce([c.values.to_numpy() for c in parts.column("g")])
        return pa.Table.from_batches([table(schema, dim=[key[0].as_py()], slot=[key[1].as_py()], g=[g])])

    parts = written(fit.mapInArrow(own, _PART), "products")
    while (last := parts.agg(F.max("slot")).first()[0]) is not None:
        up = written(parts.withColumn("slot", F.floor(F.col("slot") / FAN)).groupBy("dim", "slot").applyInArrow(add, _PART), "products")
        drop_written(parts)
        parts = up
        if last < FAN:
            break
    found = {r.dim: np.array(r.g) for r in parts.collect()}  # one matrix per length
    drop_written(parts)
    return {dim: g.reshape((round(len(g) ** 0.5),) * 2) for dim, g in found.items()}


def fit_models(fit: DataFrame) -> dict[int, Model]:
    """Models by length from the distinct vectors (dim, x)."""
    models = {dim: Model(n, s) for dim, (n, s) in _sums(fit).items()}
    for dim, g in _products(fit, models, Model.centred).items():
        models[dim].fit(g / models[dim].n)

    def with_one(model, d):
        w = model.whitened(d)
        return np.hstack([w[:, ~np.isnan(w).any(0)], np.ones((len(w), 1))])

    for dim, g in _products(fit, models, with_one).items():
        g = g / models[dim].n
        mean, c = g[-1, :-1], g[:-1, :-1]
        if len(c):
            models[dim].identity_error = float(np.abs(c - np.outer(mean, mean) - np.eye(len(c))).max())
    return models


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and
    identity_error per kept row of ``vectors`` and component."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = written(v.mapInArrow(_keys, "dim int, x binary").distinct(), "fit-vectors")
    models = fit_models(fit)
    drop_written(fit)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def out(batches):
        for b in batches:
            for at, d in _vectors(b):
                m = models[d.shape[1]]
                w = m.whitened(d)
                k = w.shape[1]
                each = pa.array(np.repeat(np.arange(len(d)), k))
                flat = w.reshape(-1)
                yield table(schema, vec_id=b.column(0).take(pa.array(at)).take(each), component=np.tile(np.arange(1, k + 1, dtype=np.int32), len(d)),
                            n=np.full(len(flat), m.n), deviation=m.deviation(d).take(each), whitened=pa.array(flat, mask=np.isnan(flat)),
                            explained=m.explained * len(d), identity_error=[m.identity_error] * len(flat))

    return v.mapInArrow(out, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
