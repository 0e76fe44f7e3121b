import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from tabulon.llm import pii as P

# the contract's patterns, taken literally
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    n = lambda m: re.sub("[^0-9]", "", m.group())
    return ([(0, *m.span()) for m in EMAIL.finditer(text)]
            + [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
            + [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(n(m)) <= 19 and plain_luhn(n(m))]
            + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(n(m)) <= 15])


def test_base_spans_on_random_strings():
    rng = random.Random(7)
    for alphabet in ("a1@. -+", "0123456789.", "0 1-2+()", "aZ9_%+-@.é\n"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert P.base_spans(text) == plain(text), text
    for _ in range(3000):  # digits that often pass the checks
        text = " ".join(rng.choice(["4465758382889437", "4465-7583-8288-9437", "+1 (743) 555-3824", "10.0.255.256", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "x@y", "𝄞"]) for _ in range(4))
        text = text.replace(" ", rng.choice([" ", "  ", ".", "x"]))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("1" * 400_000, "a" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "a.b-" * 100_000 + "@", "1 2-" * 100_000, "(at)" * 100_000):
        P.candidates(text, P.base_spans(text))
    assert time.time() - began < 20


def plain_instances(seen, support, confidence, rounds):
    """The scoring with dictionaries."""
    known = {(k, v) for k, v, seed, _ in seen if seed}
    at = defaultdict(set)
    for k, v, _, patterns in seen:
        for p in patterns:
            at[p].add((k, v))
    w = {}
    for _ in range(rounds):
        conf = {}
        for p, found in at.items():
            for k in range(4):
                seeds = sum(1 for i in found if i in known and i[0] == k)
                c = (seeds + sum(w.get(i, 0.0) for i in found if i not in known and i[0] == k)) / (len(found) + 2)
                if seeds >= support and c >= confidence:
                    conf[p, k] = c
        new = defaultdict(lambda: 1.0)
        for p, found in at.items():
            for i in found - known:
                if (p, i[0]) in conf:
                    new[i] *= 1 - conf[p, i[0]]
        w = {i: 1 - x for i, x in new.items()}
    return w


def corpus():
    rng = random.Random(11)
    texts = []
    number = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    for i in range(40):
        texts.append(f"some words then call me at {number()} before noon and go")
        texts.append(f"the price of item {rng.randrange(10**7, 10**8)} is high, {number()} of it")
        texts.append(f"the host {rng.randrange(256)}.{rng.randrange(256)}.1.{i} of it")
        texts.append(f"mail to ann.{i}@mail{i % 7}.example.com for more")
    texts += ["please do call me at 212 555 0147 before noon", "serial 212-555-0198-2 of nothing", "please write mail to bob at example dot org for more",
              "pay by 4465758382889437 4465758382889437 now", "a card 4465758382889437 alone", None, "", " ", "no data here", "call me at home"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[0]), (None, texts[1]), (None, None), (900, texts[0] + " x" * 200_000 + " " + texts[3])]


def test_against_brute_force(spark):
    rows = corpus()
    seen = []
    for _, t in rows:
        own = P.base_spans(t or "")
        seen += [(k, P.value_of(k, (t or "")[s:e]), seed, P.patterns_of(t, k, s, e)) for seed, xs in ((True, own), (False, P.candidates(t or "", own))) for k, s, e in xs]
    w = plain_instances(seen, P.SUPPORT, P.CONFIDENCE, P.ROUNDS)
    df = spark.createDataFrame(seen, "k int, value string, seed boolean, patterns array<string>")
    got = {(r.k, r.value): r.w for r in P.instances_of(df).collect()}
    assert got.keys() == w.keys() and all(got[i] == pytest.approx(w[i]) for i in w)
    known = {(k, v) for k, v, seed, _ in seen if seed}
    want = []
    for d, t in rows:
        own = P.base_spans(t or "")
        assert own == plain(t or "")
        more = [x for x in P.candidates(t or "", own) if (i := (x[0], P.value_of(x[0], t[x[1]:x[2]]))) in w or i in known]
        text = lambda spans: ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
        want.append((d, *[sum(k == j for k, _, _ in own) for j in range(4)], hashlib.sha256(text(own).encode()).hexdigest(), text(own + more), len(more)))
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, value string, base int").repartition(3)
    out = [tuple(r) for r in P.digest(P.personal_data(docs)).collect()]
    assert sorted(out, key=str) == sorted(want, key=str)
    by = {d: s for d, *_, s, _ in out if d is not None}
    at = next(i for i, t in rows if t and "212 555 0147" in t)
    start = dict(rows)[at].index("212 555")
    assert by[at] == f"phone:{start}:{start + 12}"  # the context is that of phones
    assert by[at + 1] == ""                          # a serial number is left alone
    assert by[at + 3].count("card:") == 2            # one of a row, known from elsewhere
    assert by[at + 9] == ""
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.digest(P.personal_data(none)).collect() == []


def test_copies_give_no_confidence(spark):
    seen = [(3, "12345678901", True, ["1 near"])] * 500 + [(3, "7654321", False, ["1 near"])]
    df = spark.createDataFrame(seen, "k int, value string, seed boolean, patterns array<string>")
    assert P.instances_of(df).collect() == []


def test_odd_documents(spark, odd, none):
    out = P.digest(P.personal_data(odd)).collect()
    assert len(out) == odd.count() and {r.spans for r in out} == {""}
    assert P.personal_data(none).count() == 0


def test_query(spark):
    import __spark_entry__ as E
    from tabulon.sources.tables import table
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in E.queries()["op13_pii"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(out) == len(docs)
    for r in docs:
        own = plain(r.text or "")
        listed = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in own)
        o = out[r.doc_id]
        assert [o.n_email, o.n_ip, o.n_card, o.n_phone] == [sum(k == j for k, _, _ in own) for j in range(4)]
        assert o.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(o.spans.split(",")) and len(list(filter(None, o.spans.split(",")))) == len(own) + o.n_added
