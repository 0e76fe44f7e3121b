import hashlib

import numpy as np
from helpers import odd_rows, words
from tabulon.llm.substring import lengths_up_to, substring_dedup, window_hashes


def brute(rows, length=13):
    first, out = {}, []
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            x = float("inf") if d is None else d
            first[k] = min(first.get(k, x), x)
    for d, t in rows:
        w, x = words(t), float("inf") if d is None else d
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < x:
                gone |= set(range(i, i + length))
        kept = b" ".join(a for i, a in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, length=13):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup(df, length).collect()), key=str)


def test_odd_rows(odd):
    assert got(odd) == brute([(r[0], r[1]) for r in odd_rows()])


def test_whole_table(few):
    assert got(few) == brute([(r.doc_id, r.text) for r in few.collect()])


def test_other_length(spark):
    rows = [(1, "a b c d e"), (2, "x b c d y"), (3, "b c"), (4, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (1, 2, 3, 4):
        assert got(df, length) == brute(rows, length)


def test_spans(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x a b c d y")], "doc_id long, text string")
    r = [x for x in substring_dedup(df, 3).collect() if x.doc_id == 2][0]
    assert [(s.start, s.end) for s in r.removed] == [(1, 5)] and r.kept == "x y"


def test_no_rows(none):
    assert substring_dedup(none).count() == 0


def test_levels():
    for n in (1, 2, 7, 13, 50):
        levels = lengths_up_to(n)
        assert levels[0] == 1 and levels[-1] == n and all(b <= 2 * a for a, b in zip(levels, levels[1:]))
    h = np.arange(40, dtype=np.uint64) % np.uint64(9)
    w = window_hashes(h, 13)[1]
    assert len(w) == 28
    for i in range(28):
        for j in range(28):
            assert (w[i] == w[j]) == (list(h[i:i + 13]) == list(h[j:j + 13]))
