import random
import re
from collections import Counter

import numpy as np
import pytest
from tabulon.llm import phrases as P


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, longest, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in plain_words(text):
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in cand.items():
        cut = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        inside = any(la == lang and len(h) > len(g) and 100 * b >= 100 * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (la, h), b in cand.items())
        if not inside:
            k = cut[1]
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], cut[0]))
    kept = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        kept += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(kept)


def got(df, *args):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in P.collocations(df, *args).collect())


def corpus(rng):
    stock = ["new york city", "kick the bucket", "NEW york", "of the", "a b a b a", "über straße", "𝄞 clef", "x\x0by", "tab\tbed", "\xa0odd"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(stock) + rng.choice(["", ".", ", ", " ;", "\n"]) for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("en", None), (None, None), ("en", ""), ("en", " .,;\n "), ("xx", "one two"), ("en", "a b " * 20_000)]
    return rows + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n int").repartition(4)


@pytest.mark.parametrize("longest, least, top", [(5, 10, 2000), (3, 4, 7), (1, 2, 5), (5, 10 ** 9, 5)])
def test_against_brute_force(spark, longest, least, top):
    rows = corpus(random.Random(3))
    assert got(frame(spark, rows), longest, least, top) == brute(rows, longest, least, top)


def test_many_batches_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "BYTES", 700)
    monkeypatch.setattr(P, "RANGE", 50)
    rows = corpus(random.Random(4))
    assert got(frame(spark, rows), 5, 6, 2000) == brute(rows, 5, 6, 2000)


def test_odd_documents(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(odd, 4, 3, 50) == brute(rows, 4, 3, 50)
    assert got(none) == [] and got(none, 5, 1, 5) == []


@pytest.mark.parametrize("bits, k", [(1, 2), (7, 3), (15, 2), (15, 5), (20, 4), (32, 5), (40, 2), (33, 4)])
def test_permutation_is_invertible_and_filters_lose_nothing(bits, k):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, 3000, dtype=np.uint64) >> np.uint64(rng.integers(0, bits)) for _ in range(k)]
    limbs = P.permute(ids, bits)
    assert all((a == b).all() for a, b in zip(P.restore(limbs, bits, k), ids))
    order, begin, group = P.grouped(limbs)
    f = P.QuotientFilter([x[order[begin]] for x in limbs], np.bincount(group), k * bits)
    want = Counter(zip(*(x.tolist() for x in ids)))
    for cut in (0, min(3, bits), bits):
        back = [P.QuotientFilter.unpack(d, at, cut, k * bits) for at, d in f.cells(cut)]
        found = Counter()
        for b in back:
            for g, n in zip(zip(*(x.tolist() for x in P.restore(b.limbs, bits, k))), b.counts.tolist()):
                found[g] += n
        assert found == want and sum(len(b.counts) for b in back) == len(want)
    both, _ = P.merged([f, f])
    assert (both.counts == 2 * f.counts).all() and all((a == b).all() for a, b in zip(both.limbs, f.limbs))


def test_permutation_spreads_neighbours():
    ids = [np.arange(4096, dtype=np.uint64), np.zeros(4096, np.uint64)]
    top = P.field(P.permute(ids, 13), 2 * 13 - 4, 4)
    assert np.bincount(top.astype(int), minlength=16).min() > 150


def test_narrowed():
    ids = np.array([1, 2, 3, 4, 0, 5, 6, 7, 0, 8, 9, 0])
    at = P.windows(ids, 2)
    assert at.tolist() == [0, 1, 2, 5, 6, 9]
    assert P.narrowed(ids, at, np.array([1, 1, 0, 1, 1, 1], bool), 2).tolist() == [1, 2, 3, 0, 5, 6, 7, 0]
    assert P.narrowed(ids, at, np.zeros(6, bool), 2).tolist() == []


def test_cells_grow_with_the_input(monkeypatch):
    """A cell holds an entry at least, so cells never outnumber entries."""
    rng = np.random.default_rng(1)
    for entries in (1000, 4000, 16000):
        ids = rng.integers(1, 5000, entries)
        f, at, _ = P.counted(ids, 2, 13)
        assert len(list(f.cells(13))) <= len(f.counts) <= len(at)
