import collections

import pytest
from helpers import odd_rows, words
from tabulon.llm.mixing import mix_sources, mixed, source_targets


def targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """Water filling by bisection."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, lo, hi = total * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * sizes[s], mid * w[s]) for s in names) < goal else (lo, mid)
    return {s: min(most * sizes[s], hi * w[s]) for s in names}


def check(df, rows):
    out = mix_sources(df).collect()
    assert sorted((r.doc_id, r.source, r.size) for r in out if r.doc_id is not None and r.source) == sorted((d, s, len(words(t))) for d, t, s in rows if d is not None and s)
    sizes, largest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t, s in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    return out


def test_odd_rows(odd):
    check(odd, [(r[0], r[1], r[3]) for r in odd_rows()])


def test_whole_table_and_rerun(few):
    rows = [(r.doc_id, r.text, r.source) for r in few.collect()]
    a = check(few, rows)
    b = mix_sources(few.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in a) == sorted((r.doc_id, r.copies) for r in b)


def test_mixed_rows(odd, few):
    for df in (odd, few):
        out = mixed(df)
        assert out.columns == df.columns
        want = collections.Counter()
        for r in mix_sources(df).collect():
            want[(r.doc_id, r.source)] += r.copies
        assert collections.Counter((r.doc_id, r.source) for r in out.collect()) == +want


def test_targets_reshare(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 300)], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets({"a": 10, "b": 1000, "c": 1000, "d": 5, None: 300}))


def test_no_rows_and_no_words(none, spark):
    assert mix_sources(none).count() == 0 and mixed(none).count() == 0
    df = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mix_sources(df).collect()] == [0, 0]
