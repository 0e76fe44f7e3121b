import collections
import gzip
import hashlib
import zlib

import pytest
from tabulon.llm.warc import describe, parse_record, record_bytes, salvage, sha1_base32, warc_round_trip

ROWS = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://b\r\nX: 1", None), (3, "u", ""), (4, "u", "é𝄞\r\n\r\nWARC/1.1\r\n"),
        (6, "u", "x" * 200_000), (2, "http://a/2", "<p>same</p>"), (None, "u", "lone"), (None, "u", "<p>same</p>")]


def brute(rows, least=0):
    by = collections.defaultdict(list)
    for p, _, h in rows:
        by[(h or "").encode()].append(p)
    out = []
    for payload, ids in by.items():
        win = min(ids, key=lambda p: (p is None, p or 0))
        seen = False
        for p in ids:
            first = p == win and not seen
            seen |= first
            one = first or len(payload) < least
            out.append((p, len(payload), sha1_base32(payload), "response" if one else "revisit", None if one else win))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, sha string").repartition(3)
    for least in (0, 50):
        out = warc_round_trip(df, least)
        assert out.filter("kind = 'gap'").count() == 0
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str) == brute(ROWS, least)


def test_rows_that_differ_in_their_url_alone(spark):
    rows = [(1, "http://b", "p"), (1, "http://a", "p"), (1, "http://a", "p"), (1, None, "p"), (2, "http://c", "p")]
    out = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert sorted(r.url or "" for r in out) == sorted(u or "" for _, u, _ in rows)
    assert [(r.page_id, r.url) for r in out if r.record_type == "response"] == [(1, "http://a")]


def test_no_rows(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_record():
    raw = record_bytes(7, "http://x", b"hello")
    head, block, end = parse_record(raw)
    assert end == len(raw) and head["content-length"] == str(len(block)) and describe(head, block)["payload_digest"] == sha1_base32(b"hello")
    assert sha1_base32(b"hello") == __import__("base64").b32encode(hashlib.sha1(b"hello").digest()).decode()
    for cut in (0, 5, 40, len(raw) - 1):
        with pytest.raises(ValueError):
            parse_record(raw[:cut])


def archive(n, zipped):
    parts = [record_bytes(i, f"http://x/{i}", f"page {i} ".encode() * 50) for i in range(n)]
    return [gzip.compress(p, mtime=0) if zipped else p for p in parts]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(8, zipped)
    starts = [sum(map(len, parts[:i])) for i in range(9)]

    def ids(data):
        found = list(salvage(bytes(data)))
        return [int(w[0]["x-page-id"]) for k, w in found if k == "record"], [w[:2] for k, w in found if k == "gap"]

    whole = b"".join(parts)
    assert ids(whole) == (list(range(8)), [])
    broken = bytearray(whole)
    broken[starts[3] + len(parts[3]) // 2] ^= 0x55  # a byte within record 3
    assert ids(broken) == ([0, 1, 2, 4, 5, 6, 7], [(starts[3], starts[4])])
    assert ids(whole[:starts[8] - 5]) == (list(range(7)), [(starts[7], starts[8] - 5)])  # cut short
    assert ids(whole[:starts[2]] + b"garbage" * 9 + whole[starts[2]:]) == (list(range(8)), [(starts[2], starts[2] + 63)])
    hole = whole[:starts[4] + 10] + whole[starts[6]:]  # the middle of two records is missing
    assert ids(hole) == ([0, 1, 2, 3, 6, 7], [(starts[4], starts[4] + 10)])
    assert ids(b"\x00" * 100) == ([], [(0, 100)]) and ids(b"") == ([], [])


def test_false_marks():
    payload = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + b"\x1f\x8b\x08 not a member"
    raw = record_bytes(1, None, payload)
    assert [k for k, _ in salvage(raw)] == ["record"]
    assert [k for k, _ in salvage(zlib.compress(b"x") + gzip.compress(raw))] == ["gap", "record"]


@pytest.mark.parametrize("bad", [0, 3, 7])
def test_salvage_within_a_member(bad):
    """One broken record of a member with several does not take the others along."""
    parts = archive(8, False)
    for wrong in (parts[bad].replace(b"page", b"cage"), parts[bad].replace(b"Content-Length: ", b"Content-Length: 9"), parts[bad][40:]):
        lone = gzip.compress(parts[0], mtime=0)
        member = gzip.compress(b"".join([*parts[:bad], wrong, *parts[bad + 1:]]), mtime=0)
        found = list(salvage(lone + member + lone))
        assert [int(x[0]["x-page-id"]) for k, x in found if k == "record"] == [0, *(i for i in range(8) if i != bad), 0]
        gaps = [x for k, x in found if k == "gap"]
        at = sum(map(len, parts[:bad]))
        assert [x[:2] for x in gaps] == [(len(lone), len(lone) + len(member))] and f"bytes {at} to {at + len(wrong)} of" in gaps[0][2]
