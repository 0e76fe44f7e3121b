import numpy as np
from tabulon.llm import embeddings as V


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i, a in ok:
        for j, b in ok:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = []
    for i, (vid, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vid, len(links[i]), least, vid == least))
    return sorted(out, key=str)


def got(df, threshold=0.9):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(df, threshold).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, key string"


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.35 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] + [1.0] * 7), (205, [float("inf")] + [1.0] * 7),
             (206, [1.0, 0.0]), (207, [1.0, 0.1]), (3, rows[3][1]), (None, rows[3][1]), (None, [5.0, -5.0, 0.0]), (208, [-0.0, 2.0, 0.0]), (209, [0.0, 3.0, 0.0]), (210, [1e-30, 0.0, 0.0]), (211, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA).repartition(3)
    for threshold in (0.9, 0.6):
        assert got(df, threshold) == brute(rows, threshold)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "TILE", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(300)]
    assert got(spark.createDataFrame([(*r, "k") for r in rows], SCHEMA)) == brute(rows, 0.9)


def test_bound_loses_nothing():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(500, 48)) * np.linspace(3, 0.1, 48)
    u = V._units(v)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    a = V._prepared(v, axes)
    for threshold in (0.3, 0.5, 0.8):
        found = {(i, j) for p, q in V._pairs(a, a, True, threshold) for i, j in zip(p.tolist(), q.tolist())}
        s = u @ u.T
        assert found == {(i, j) for i, j in zip(*np.nonzero(s >= threshold)) if i < j}


def test_roots():
    rng = np.random.default_rng(8)
    for _ in range(20):
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        label = list(range(60))
        for _ in range(60):
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
        assert V.roots(60, a, b).tolist() == label
