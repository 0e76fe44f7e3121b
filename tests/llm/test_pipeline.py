import collections

import corpus_pipeline as P
import pytest
from helpers import words
from tabulon.llm import components as C, exact_dedup as E, near_dup as N, packing as K
from tabulon.llm.common import written
from tabulon.sources.tables import table
from test_near_dup import sets

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, BASE, "documents"), []
    for name, stage in P.STAGES:
        out.append(docs.collect())
        docs = written(stage(spark, docs, BASE), name.replace(" ", "-"))
    return [*out, docs.collect()]


def test_stages(steps, spark):
    raw, clean, exact, near, mix, packed = steps
    toxic = {r.doc_id: r.toxic for r in table(spark, BASE, "labels").collect()}
    ids = {r.doc_id for r in clean}
    assert ids < {r.doc_id for r in raw} or len(ids) == len(raw)
    gone = [r.doc_id for r in raw if r.doc_id not in ids]
    assert sum(toxic.get(d) == 0 for d in gone) <= 0.1 * len(raw)
    best = {}
    for r in clean:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in exact} == set(best.values()) and len(exact) == len(best)
    s = {r.doc_id: sets(r.text, 5) for r in exact}
    link = lambda a, b: bool(s[a] and s[b]) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
    left, want = sorted(s), set()
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            new = {y for y in left if y not in group and link(x, y)}
            group |= new
            todo += new
        want.add(min(group))
        left = [x for x in left if x not in group]
    assert {r.doc_id for r in near} == want and len(near) == len(want)
    copies = collections.Counter(r.doc_id for r in mix)
    assert set(copies) <= want and max(copies.values()) <= 2
    total, own = sum(len(words(r.text)) for r in mix), sum(len(words(r.text)) for r in near)
    assert 1.2 * own <= total <= 1.6 * own
    assert {r.doc_id for r in packed if r.piece == 0} == set(copies)
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies
    for docs in steps[1:5]:
        assert set(docs[0].asDict()) == set(raw[0].asDict())


def test_no_stage_sends_exploded_bands_or_documents_through_the_driver(spark, monkeypatch):
    """A class has 36 bands, which Spark counts as one: at 0.6 GB it took all of them
    for small enough to broadcast."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (C, E, N, K):
        monkeypatch.setattr(module, "written", lambda df, name: plan(df) or written(df, name))
    text = " ".join(f"t{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{text} {i % 7}", "s") for i in range(20)], "doc_id long, text string, source string")
    stages = dict(P.STAGES)
    for name in ("exact dedup", "MinHash near-dedup", "best-fit packing"):
        plan(stages[name](spark, docs, BASE))
    assert any("__tb_digest" in p for p in plans) and any("band" in p for p in plans) and any("joint" in p for p in plans)
    for key in ("band", "__tb", "shard", "row", "digest"):
        assert not any(f"BroadcastHashJoin [{key}" in p for p in plans), key


def test_registered_query():
    import __spark_entry__ as E
    assert "pipeline" in E.queries() and [n for n, _ in P.STAGES] and {f"op{i}" for i in range(1, 14)} == {k.split("_")[0] for k in E.queries() if k.startswith("op")}
