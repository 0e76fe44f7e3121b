import collections
import hashlib

from helpers import odd_rows
from pyspark.sql import functions as F
from tabulon.llm.exact_dedup import PerfectHash, drop_copies, exact_dedup


def brute(rows):
    by = collections.defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    win = {t: max(ds, key=lambda d: (d is not None, d or 0)) for t, ds in by.items()}
    return by, win


def check(df, rows, **options):
    by, win = brute(rows)
    out = exact_dedup(df, **options).collect()
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    assert sorted(((r.doc_id, texts[r.text_sha256]) for r in out), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    for r in out:
        t = texts[r.text_sha256]
        assert r.keep_id == win[t] and r.group_size == len(by[t])
        assert not r.kept or r.doc_id == win[t]
    assert collections.Counter(r.text_sha256 for r in out if r.kept) == {h: 1 for h in texts}


def test_odd_rows(odd):
    check(odd, [(r[0], r[1]) for r in odd_rows()])


def test_any_history_gives_the_same(odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for history in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        check(odd, rows, history=history)


def test_drop_copies(odd):
    out = drop_copies(odd)
    assert out.columns == odd.columns
    _, win = brute([(r[0], r[1]) for r in odd_rows()])
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted(((d, t) for t, d in win.items()), key=str)


def test_no_rows(none):
    assert exact_dedup(none).count() == 0 and drop_copies(none).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 100, 3000):
        keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        h = PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(n))
        others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)]
        assert all(-1 <= s < n for s in h.slots(others))
