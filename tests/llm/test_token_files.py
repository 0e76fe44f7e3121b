import zlib

import numpy as np
import pytest
from helpers import odd_rows
from tabulon.llm.token_files import PackedFile, bits_for, file_bytes, pack_bits, token_file_round_trip, unpack_bits
from test_packing import whole


def test_every_width():
    rng = np.random.default_rng(3)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
            raw = pack_bits(ids, bits)
            assert len(raw) == -(-n // 8) * bits and (unpack_bits(raw, n, bits) == ids).all()


def test_bits():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_random_access():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 700, 60)
    ids = rng.integers(0, 49408, counts.sum()).astype(np.uint32)
    f = PackedFile(file_bytes([None, *range(1, 60)], counts, ids, 16, block=64, first=5))
    assert f.doc_ids[:2] == [None, 1] and f.first == 5 and f.n_ids == len(ids)
    ends = np.cumsum(counts)
    for i in (0, 59, 30, 17, 0):
        assert (f.document(i) == ids[ends[i] - counts[i]:ends[i]]).all()
    for lo, hi in ((0, 0), (63, 65), (1, 1000), (len(ids) - 1, len(ids))):
        assert (f.ids(lo, hi) == ids[lo:hi]).all()
    with pytest.raises(ValueError):
        PackedFile(b"x" * 100)


def check(df, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for d, t in rows:
        ids = whole(t) + [1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file_round_trip(df).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_odd_rows(odd):
    check(odd, [(r[0], r[1]) for r in odd_rows()])


def test_whole_table(few):
    check(few, [(r.doc_id, r.text) for r in few.collect()])


def test_no_rows(none):
    assert token_file_round_trip(none).count() == 0
