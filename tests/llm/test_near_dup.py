import re

import numpy as np
import pytest
from helpers import odd_rows, words
from tabulon.llm import components as C, near_dup as N
from tabulon.llm.components import components


def sets(text, width):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    s = [sets(t, width) if words(t) else set() for _, t in rows]
    links = {i: {j for j in range(len(rows)) if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])} for i in range(len(rows))}
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((d, len(s[i]), least, d == least))
    return sorted(out, key=str)


def got(df, width, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, width, percent).collect()), key=str)


def test_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert got(odd, 3, 85) == brute(rows, 3, 85)
    assert got(none, 3, 85) == []


def near_group(seed=9, n=90, words_=220):
    """Copies of a text with words changed here and there: chains of links on
    both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words_)]
    rows = []
    for i in range(n):
        t = list(base)
        for k in rng.integers(0, words_, int(rng.integers(0, 8))):
            t[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(t)))
    return rows + [(1000 + i, " ".join(f"v{k}" for k in rng.integers(0, 5000, 80))) for i in range(40)]


def test_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)
    rows = near_group()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, 3, 85) == brute(rows, 3, 85)


def test_one_of_each_group_stays(odd):
    out = N.drop_near_duplicates(odd, 5, 80)
    assert out.columns == odd.columns
    rows = [(r[0], r[1]) for r in odd_rows()]
    s = [sets(t, 5) if words(t) else set() for _, t in rows]
    want, left = set(), list(range(len(rows)))
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            x = s[todo.pop()]
            new = {k for k in left if k not in group and x and s[k] and 100 * len(x & s[k]) >= 80 * len(x | s[k])}
            group |= new
            todo += new
        want.add(min((rows[k] for k in group), key=lambda m: (m[0] is None, m[0] or 0)))
        left = [k for k in left if k not in group]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(10)
    for share in (0.85, 0.9, 0.95):
        errors = []
        for _ in range(60):
            n = 800
            a = rng.integers(0, 2**62, n, dtype=np.uint64)
            b = a.copy()
            change = int(n * (1 - share) / (1 + share))
            b[:change] = rng.integers(0, 2**62, change, dtype=np.uint64)
            d = np.bitwise_count(N.odd_sketch(N.samples(a)) ^ N.odd_sketch(N.samples(b))).sum()
            errors.append(float(N.estimate(d)) - (n - change) / (n + change))
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < N.SLACK


def test_groups_connect_as_all_links_do():
    rng = np.random.default_rng(11)
    for trial in range(20):
        base = rng.integers(0, 2**62, 60, dtype=np.uint64)
        items = []
        for _ in range(25):
            x = base.copy()
            k = rng.integers(0, 9)
            x[rng.choice(60, k, replace=False)] = rng.integers(0, 2**62, k, dtype=np.uint64)
            items.append(np.unique(x))
        n = np.array([len(x) for x in items])
        sketch = np.stack([N.odd_sketch(N.samples(x)) for x in items])
        comp = np.arange(25)
        want = list(range(25))
        for a in range(25):
            for b in range(a):
                both = len(np.intersect1d(items[a], items[b]))
                if 100 * both >= 85 * (n[a] + n[b] - both):
                    want = [want[a] if w == want[b] else w for w in want]
        for single in (0, 10_000):
            N.SINGLE, keep = single, N.SINGLE
            links = N.connect(comp, np.zeros(25, bool), n, sketch, items, 85, False)
            N.SINGLE = keep
            got = list(range(25))
            for a, b in links:
                assert got[a] != got[b]
                got = [got[a] if w == got[b] else w for w in got]
            assert len(set(got)) == len(set(want)) == 25 - len(links)


def test_components(spark):
    rng = np.random.default_rng(12)
    edges = [(int(x), int(y)) for x, y in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: r for x, r in label.items() if x != r}


def test_bands_and_slack_follow_the_threshold():
    """At 0.8 as at 0.85 a pair shares no band once in a million times, and
    its estimate stays within five standard deviations."""
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** N.ROWS) ** N.bands(percent) < 1e-6
    assert N.bands(85) == 24 and N.slack(85) == pytest.approx(N.SLACK, abs=0.002) and N.slack(80) > 0.19
    a = np.arange(1, 500, dtype=np.uint64)
    assert (N.samples(a, 36 * N.ROWS)[:N.SAMPLES] == N.samples(a)).all() and len(set(N.samples(a, 36 * N.ROWS))) > 150


def test_signatures_have_the_bands_of_the_threshold(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert [len(N.signatures(docs, 5, percent).first().bands) for percent in (80, 85)] == [36, 24]


def test_the_bitmap_of_few_rows_reaches_the_driver_small(spark, monkeypatch):
    """Its ranges are compressed: a row here and there is not 16 KB each."""
    at = [int(x) for x in np.random.default_rng(13).integers(-2**63, 2**63, 400)]
    sent, unpacked = [], N.unpacked
    monkeypatch.setattr(N, "unpacked", lambda data: sent.append(len(data)) or unpacked(data))
    bits = np.unpackbits(N._bitmap(spark.createDataFrame([(x,) for x in at], "at long")))
    assert np.flatnonzero(bits).tolist() == sorted({x & ((1 << N.MARKS) - 1) for x in at})
    assert len(sent) > 200 and sum(sent) < 400 * 200


def test_tables_of_classes_are_joined_by_key(spark, monkeypatch):
    """Their files are far smaller than their rows: taken for small, they were sent
    through the driver.  Only tables with a row per large cluster may be."""
    plans, write = [], N.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (N, C):
        monkeypatch.setattr(module, "written", lambda df, name: plan(df) or write(df, name))
    monkeypatch.setattr(N, "CHUNK", 16)
    df = spark.createDataFrame(near_group(), "doc_id long, text string").repartition(4)
    plan(N.drop_near_duplicates(df, 3, 85))
    keys = {k for p in plans for k in re.findall(r"Broadcast\w*Join \[([^#\]]*)", p)}
    assert len(plans) > 15 and keys <= {"g"}, keys
