import numpy as np
import pytest
from tabulon.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, key string"


def check_eigen(a, tol=2e-13):
    lam, x = W.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < tol
    assert np.abs(a @ x - x * lam).max() < tol * size * len(a)
    assert np.abs(lam - np.linalg.eigvalsh(a)[::-1]).max() < tol * size * len(a)


@pytest.mark.parametrize("gaps", [None, 1e-3, 1e-6, 1e-8, 1e-10, 1e-13, 0.0])
def test_eigenvectors_to_double_precision(gaps):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        lam = rng.random(n) * 10 if gaps is None else np.repeat([3.0, 1.0, 0.0], [n // 2, n // 4, n - n // 2 - n // 4]) + gaps * np.arange(n)
        check_eigen((q * lam) @ q.T)


def test_clusters_are_resolved_where_double_precision_can():
    rng = np.random.default_rng(4)
    n = 30
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    lam = np.concatenate([5 + 1e-9 * np.arange(10), 2 + 1e-7 * np.arange(10), np.linspace(0.1, 1, 10)])
    got, x = W.eigen((q * lam) @ q.T)
    for j, k in enumerate(np.argsort(-lam)):
        gap = np.abs(np.delete(lam, k) - lam[k]).min()
        assert min(np.abs(x[:, j] - q[:, k]).max(), np.abs(x[:, j] + q[:, k]).max()) < 2e-14 / gap


def brute(rows):
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for dim in sorted({len(x) for _, x in kept}):
        mine = [(i, x) for i, x in kept if len(x) == dim]
        fit = np.array(sorted({tuple(x) for _, x in mine}), object)
        n, s = len(fit), fit.sum(0)
        y = ((n * fit - s) / n).astype(float)
        v = y.T @ y / n
        lam, q = np.linalg.eigh(v)
        lam, q = lam[::-1], q[:, ::-1]
        for i, x in mine:
            z = n * np.array(x, object) - s
            for c in range(min(16, dim)):
                good = lam[c] > dim * 2.3e-16 * lam[0] and lam[0] > 0
                out.append((i, c + 1, n, int((z * z).sum()), abs(float((z / n).astype(float) @ q[:, c])) / np.sqrt(lam[c]) if good else None, lam[c] / np.trace(v) if np.trace(v) > 0 else None))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[1], r[3], r[4] is not None and round(r[4], 3))
    got = [(r.vec_id, r.component, r.n, None if r.deviation is None else int(r.deviation), None if r.whitened is None else abs(r.whitened), r.explained) for r in got]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        if g[4] is not None:
            assert g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-7)
        if g[5] is not None:
            assert g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-12)


def odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=20) * np.linspace(0.2, 3, 20)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(400 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(9)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, None), (200, None), (201, []), (202, [1.0, None]), (203, [float("nan")] * 20), (204, [float("inf")] + [0.0] * 19)]
    return rows + [(205, rows[7][1]), (206, [1.5] * 7), (207, [1.5] * 7)]  # one distinct vector alone: trace 0


def test_against_brute_force(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).repartition(5)
    got = W.whiten(df).collect()
    same(got, brute(rows))
    assert all(r.identity_error < 1e-9 for r in got if r.identity_error is not None)
    assert {r.identity_error for r in got if r.vec_id == 206} == {None}


def test_rank_and_size(spark):
    few = [(i, [float(i), 2.0 * i + (i == 2), 7.0, -float(i)]) for i in range(4)]  # two directions at most
    same(W.whiten(spark.createDataFrame([(*r, "k") for r in few], SCHEMA)).collect(), brute(few))
    large = [(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [3.0, 0.0])]
    got = W.whiten(spark.createDataFrame([(*r, "k") for r in large], "vec_id long, embedding array<double>, key string")).collect()
    assert [int(r.deviation) for r in sorted(got, key=lambda r: (r.vec_id, r.component))][::2] == [b[3] for b in brute(large)][::2]
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).repartition(8)
    same(W.whiten(df).collect(), brute(rows))


def test_query(spark):
    import __spark_entry__ as E
    from tabulon.sources.tables import table
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    df = E.queries()["op11_whitening"](spark, sf)
    assert dict(df.dtypes)["deviation"] == "bigint" and dict(df.dtypes)["n"] == "bigint"
    same(df.collect(), brute(rows))
