import collections
import itertools
import zlib

import numpy as np
import pytest
from helpers import odd_rows, words
from tabulon.llm import lm


def test_seating_follows_its_conditional():
    """Against all seatings of a few customers, counted one by one."""
    d, rng = 0.8, np.random.default_rng(1)
    for c, a in ((2, 0.3), (4, 1.5), (5, 0.02)):
        weight = collections.Counter()
        for p in itertools.product(range(c), repeat=c):  # table of each customer, in order of opening
            if all(x <= max(p[:i], default=-1) + 1 for i, x in enumerate(p)):
                sizes, w = collections.Counter(), 1.0
                for x in p:
                    w *= a if sizes[x] == 0 else sizes[x] - d
                    sizes[x] += 1
                weight[len(sizes)] += w
        total = sum(weight.values())
        t = lm.seat(np.full(40_000, c), np.full(40_000, a), d, rng)
        for k in weight:
            assert (t == k).mean() == pytest.approx(weight[k] / total, abs=0.012)
    t = lm.seat(np.array([1, 1, 500, 100_000]), np.array([1e9, 1e-12, 1.0, 2.0]), d, rng)
    assert t[0] == t[1] == 1 and 1 <= t[2] <= 500 and t[2] < t[3] <= 100_000


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    v, pairs = 50, np.unique(rng.integers(0, 50 * 20, 300))
    word, context = pairs // 20, pairs % 20
    word = np.unique(word, return_inverse=True)[1]
    v = word.max() + 1
    b = lm.Bucket(np.arange(v, dtype=np.uint64), word, context, rng.integers(1, 60, len(pairs)))
    g = lm.Totals(b.context_sums(b.c), b.context_sums(b.t), b.t0.sum(), v)
    for _ in range(3):
        b.sweep(g, rng)
        g = lm.Totals(b.context_sums(b.c), b.context_sums(b.t), b.t0.sum(), v)
        assert (b.t >= 1).all() and (b.t <= b.c).all() and (b.t0 >= 1).all() and (b.t0 <= b.root_customers(b.t)).all()
    root = np.append(g.root(b.root_customers(b.t), b.t0), g.root(0, 0))
    assert root.sum() == pytest.approx(1)
    for u in range(21):
        c, t = np.zeros(v + 1), np.zeros(v + 1)
        at = b.context == u
        c[b.word[at]], t[b.word[at]] = b.c[at], b.t[at]
        assert g.context(u, c, t, root).sum() == pytest.approx(1)


def check(df, rows):
    out = lm.score_documents(df).collect()
    tokens = [[*words(t, lower=True), None] for _, t in rows]
    train = [zlib.crc32(str("" if d is None else d).encode()) % 5 != 1 for d, _ in rows]
    count = collections.Counter(w for t, k in zip(tokens, train) if k for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted(((d, not k, len(t), sum(count[w] > 0 for w in t), round(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for (d, _), t, k in zip(rows, tokens, train)), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out), key=str) == want
    assert {r.train_tokens for r in out} == {n}
    assert all(np.isfinite(r.score) and r.score <= 0 for r in out)
    return out


def test_odd_rows(odd, none):
    check(odd, [(r[0], r[1]) for r in odd_rows()])
    assert lm.score_documents(none).count() == 0


def test_held_out_perplexity(few):
    out = check(few, [(r.doc_id, r.text) for r in few.collect()])
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.n_known for r in out}
    assert len(again) == len(out)


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    out = lm.score_documents(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens) for r in out] == [(0, 0)] * 3 and all(np.isfinite(r.score) for r in out)


def test_a_word_served_mostly_in_one_context():
    """Taking its customers out leaves fewer than the root has tables."""
    rng = np.random.default_rng(3)
    b = lm.Bucket(np.arange(1, dtype=np.uint64), np.array([0, 0]), np.array([1, 2]), np.array([90_000, 2]))
    b.t, b.t0 = np.array([5_000, 1]), np.array([4_000])
    g = lm.Totals(b.context_sums(b.c), b.context_sums(b.t), b.t0.sum(), 1)
    for _ in range(5):
        b.sweep(g, rng)
        assert (b.t >= 1).all() and (b.t <= b.c).all() and 1 <= b.t0[0] <= b.t.sum()
        g = lm.Totals(b.context_sums(b.c), b.context_sums(b.t), b.t0.sum(), 1)


def test_every_word_is_a_context_of_its_own(spark):
    """However many there are; and all buckets are told the same exact totals."""
    rows = [(i, " ".join(f"w{i * 60 + k}" if k % 3 else "often" for k in range(100))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    state = lm.written(docs.mapInArrow(lm._cells(5, False), lm._STATE_SQL).groupBy("bucket").applyInArrow(lm._counted(5, lm.ASK), lm._STATE_SQL), "counts")
    customers, tables, want, pairs = {}, {}, collections.Counter(), set()
    for r in lm._with_totals(state).filter(f"part = {lm.CONTEXT}").collect():
        a = lm.unpacked(r.data)
        for u, c, t in zip(lm._hashes(a["contexts"]).tolist(), a["customers"].tolist(), a["tables"].tolist()):
            assert customers.setdefault(u, c) == c and tables.setdefault(u, t) == t
    for d, text in rows:
        h = [int(lm.START), *lm.hashes(words(text, lower=True)).tolist()]
        for u, w in zip(h, [*h[1:], int(lm.END)]):
            want[u] += lm.is_training(d)
            if lm.is_training(d):
                pairs.add((u, w))
    assert len(want) > 1 << 14 and customers == dict(want)
    assert tables == {u: 0 for u in want} | collections.Counter(u for u, _ in pairs)
    assert len(lm.score_documents(docs).collect()) == len(rows)


def test_a_hot_word_is_scored_in_several_groups(spark, monkeypatch):
    """No group grows with a word's frequency, and the scores stay the same."""
    rows = [(i, "hot " * 200 + f"rare{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12).cache()
    once = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "ASK", 4_000)
    dealt, seen = lm._dealt, []
    monkeypatch.setattr(lm, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    out = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    assert out == pytest.approx(once, abs=1e-9) and len(out) == len(rows)
    tokens, models = collections.Counter(), collections.Counter()
    for r in seen[0].select("bucket", "group", "part", "data").collect():
        if r.part == lm.ASKED:
            tokens[r.bucket, r.group] += len(lm.unpacked(r.data)["doc"])
        models[r.bucket, r.group] += r.part == lm.MODEL
    assert sum(tokens.values()) == 120 * 202 and len(tokens) > 2 and max(tokens.values()) < sum(tokens.values()) / 2
    assert all(models[k] == 1 for k in tokens)


def test_documents_are_scored_part_by_part(spark, monkeypatch):
    """The cells of one part only are exchanged at a time, and the scores stay the same."""
    rows = [(None if i % 50 == 0 else i // 2, None if i % 45 == 0 else " ".join(f"w{(i * k) % 97}" for k in range(i % 60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    monkeypatch.setattr(lm, "BUCKET_DOCS", 50)
    dealt, seen = lm._dealt, []
    monkeypatch.setattr(lm, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.base_score, r.score)
    out = sorted(lm.score_documents(docs).collect(), key=key)
    bytes_ = [sum(len(r.data) for r in d.filter(f"part = {lm.ASKED}").select("data").collect()) for d in seen]
    assert len(bytes_) == 4 and max(bytes_) < 0.4 * sum(bytes_)
    monkeypatch.setattr(lm, "SLICES", 1)
    whole = sorted(lm.score_documents(docs).collect(), key=key)
    assert len(seen) == 5 and len(out) == len(rows)
    assert [r[:5] for r in out] == [r[:5] for r in whole]
    assert [r.score for r in out] == pytest.approx([r.score for r in whole], abs=1e-9)


def test_a_model_is_read_once_for_all_cells(monkeypatch):
    """Scoring many batches against a bucket goes over its pairs as often as for one batch."""
    calls = collections.Counter()
    old = lm.Bucket.root_customers
    monkeypatch.setattr(lm.Bucket, "root_customers", lambda self, t: calls.update(n=1) or old(self, t))
    words_ = np.sort(lm.hashes([b"a", b"b", b"c"]))
    b = lm.Bucket(words_, np.arange(3), np.zeros(3, np.int64), np.array([3, 4, 5]), np.array([lm.START], np.uint64))
    one = np.ones(3, np.int64)
    state = lm._state(0, 1, b, [(one, one, np.array([3, 0]))] * lm.KEEP)
    model = [r for r in state.to_pylist() if r["part"] in (lm.MODEL, lm.CONTEXT)]
    cell = lm.packed(batch=np.array([7]), words=lm._planes(words_), pairs=np.ones(3, np.uint32), contexts=lm._planes(np.array([lm.START], np.uint64)),
                     context=np.zeros(3, np.uint16), tokens=np.ones(3, np.uint32), doc=np.zeros(3, np.uint16))
    score, counts = lm._scored([[12, 3, 3, 3]] * lm.KEEP, 12, 3), []
    for n in (1, 20):
        calls.clear()
        asked = [{"bucket": 0, "part": lm.ASKED, "home": k, "data": cell} for k in range(n)]
        out = score(None, lm.pa.Table.from_pylist(model + asked, schema=lm._STATE))
        counts.append(calls["n"])
        assert out.num_rows == n and len({d for d in out.column("data").to_pylist()}) == 1
    assert counts[0] == counts[1]


def test_words_are_hashed_once_each():
    found = [b"b", b"a", b"", b"b", b"c", b"", b"a", b"x" * 100]
    h, at = lm.distinct(found)
    assert h[at].tolist() == lm.hashes(found).tolist() and len(h) == 5
    assert [len(x) for x in lm.distinct([])] == [0, 0]


def test_distinct_values_of_stretches():
    rng = np.random.default_rng(5)
    x, ends = rng.integers(0, 40, 300), np.array([0, 0, 7, 120, 120, 300, 300])
    for most in (40, 1 << 58):
        own, place, lists = lm._ranked(x, most, ends)
        for lo, hi, a, b in zip(ends, ends[1:], lists, lists[1:]):
            want, where = np.unique(x[lo:hi], return_inverse=True)
            assert own[a:b].tolist() == want.tolist() and place[lo:hi].tolist() == where.tolist()
        assert lm._order(x, most).tolist() == np.argsort(x, kind="stable").tolist()
    assert [len(a) for a in lm._ranked(x[:0], 5, np.zeros(3, np.int64))] == [0, 0, 3]


def test_words_of_many_texts_at_once():
    texts = [None, "", " \n\t ", "One two\x0bone", "a\x1cb c\xa0d", "  É ÉTÉ 𝄞 ſ İ\x00 x", "x " * 40, "end"]
    for some in (texts, texts[::-1], [None], [], ["a"], [" "]):
        h, at, counts = lm.tokens(some)
        assert h[at].tolist() == [x for t in some for x in lm.hashes(words(t, lower=True)).tolist()]
        assert counts.tolist() == [len(words(t)) for t in some] and len(set(h.tolist())) == len(h)


def test_counts_tell_words_apart_by_cell_not_by_pair(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(200))) for i in range(60)], "doc_id long, text string").repartition(2)
    cells = docs.mapInArrow(lm._cells(1, False), lm._STATE_SQL).toArrow()
    found = [lm.unpacked(x) for x in cells.column("data").to_pylist()]
    unique, seen = np.unique, []
    monkeypatch.setattr(np, "unique", lambda x, **k: seen.append(len(x)) or unique(x, **k))
    out = lm._counted(1, lm.ASK)((lm.pa.scalar(0),), cells).to_pylist()
    monkeypatch.undo()
    listed, pairs = sum(len(lm._hashes(c["contexts"])) for c in found), sum(int(c["pairs"].sum()) for c in found)
    assert max(seen) <= listed + 1 < pairs / 4
    want = collections.Counter()
    for r in docs.collect():
        h = [int(lm.START), *lm.hashes(words(r.text, lower=True)).tolist()]
        for u, w in zip(h, [*h[1:], int(lm.END)]):
            want[w, u] += lm.is_training(r.doc_id)
    model = lm.unpacked(next(r["data"] for r in out if r["part"] == lm.MODEL))
    contexts = np.concatenate([lm._hashes(lm.unpacked(r["data"])["contexts"]) for r in out if r["part"] == lm.CONTEXT])
    w = np.repeat(lm._hashes(model["words"]), model["pairs"])
    assert dict(zip(zip(w.tolist(), contexts[model["context"]].tolist()), model["c"].tolist())) == {k: n for k, n in want.items() if n}
