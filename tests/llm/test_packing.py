import zlib

import numpy as np
from helpers import odd_rows
from tabulon.llm import bpe
from tabulon.llm.packing import pack, place


def whole(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path()).encode(text or "", add_special_tokens=False).ids


def brute_place(lengths, capacity):
    """Try every gap and count the sum of squares in full."""
    bins, out = [], []
    for s in lengths:
        def total(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g > 0)
        best = None
        for g in sorted({capacity - b for b in bins if capacity - b >= s}):
            after = [capacity - b for b in bins]
            after.remove(g)
            after.append(g - s)
            if best is None or total(after) < best[0]:
                best = (total(after), g)
        new = total([capacity - b for b in bins] + [capacity - s])
        if best is not None and best[0] <= new:
            k = bins.index(capacity - best[1])
            out.append((capacity - best[1], best[0]))
            bins[k] += s
        else:
            out.append((0, new))
            bins.append(s)
    return sorted(bins), [o for o, _ in out]


def test_place_follows_the_rule():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 21, 40)
        bins, offsets = place(lengths, 20)
        filled = np.bincount(bins, weights=lengths).astype(int)
        want, at = brute_place(lengths.tolist(), 20)
        assert sorted(filled.tolist()) == want and offsets.tolist() == at


def check(df, rows, capacity=2048):
    out = pack(df, capacity=capacity).collect()
    want = []
    for d, t in rows:
        ids = whole(t) + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want.append((d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(r.length for r in out)


def test_odd_rows(odd):
    check(odd, [(r[0], r[1]) for r in odd_rows()])
    check(odd, [(r[0], r[1]) for r in odd_rows()], capacity=7)


def test_whole_table_is_tight(few):
    n, total = check(few, [(r.doc_id, r.text) for r in few.collect()])
    assert n <= 1.05 * total / 2048 + 2


def test_no_rows(none):
    assert pack(none).count() == 0


def test_chunks_are_whole_texts():
    cache = bpe.ChunkCache(bpe.default_path())
    texts = [t for _, t, *_ in odd_rows() if t] + ["", "don't we'll I'M 've", "é ́x Å", "ΟΔΟΣ ς İstanbul ﬁn ǅ", "<|startoftext|>a<|endoftext|>", "a<|b |>", "x​y﻿", "tab\tnew\nline\r\x0b\x0cff",
                                                   "word,,, (a)b [c] --- ___ 123 4.5e6 &&&", "日本語 テキスト emoji 👍🏽", "ªµº ÀÖ×÷ß"]
    for t in texts:
        assert np.frombuffer(bpe.encode(t, cache), "<u4").tolist() == whole(t), t
