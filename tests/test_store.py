"""The dataset store under several writers and crashes, stored results, and
profiles joined from the states of parts."""

import threading

import pytest
from pyspark.sql import functions as F

from tabulon.operators import profile as PF
from tabulon.operators import profile_state as PS
from tabulon.sources import io as IO
from tabulon.sources.tables import table
from tabulon.sources.versions import Conflict, Versions

SF = "/root/testdata/sf0.001"


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest("a/b") == (0, None) and v.all("x int").collect() == []
    assert v.put("a/b", 1, {"x": 1}) and not v.put("a/b", 1, {"x": 2})
    assert v.latest("a/b") == (1, {"x": 1})
    for _ in range(12):
        v.change("a/b", lambda s: {"x": s["x"] + 1})
    v.change("c", lambda s: {"x": 100 if s is None else 0})
    assert v.latest("a/b") == (13, {"x": 13})
    assert sorted(r.x for r in v.all("x int").collect()) == [13, 100]
    assert len(list((tmp_path / "v" / "a" / "b").glob("*.json"))) <= 10  # old states go
    taken = lambda s: v.put("c", v.latest("c")[0] + 1, {"x": -1}) and {"x": 1}  # noqa: E731 - another writer is always first
    with pytest.raises(Conflict):
        v.change("c", taken, attempts=3)
    (tmp_path / "v" / "c" / ".half-written").write_text('{"x": 5')
    assert v.latest("c")[1] == {"x": -1} and v.all("x int").count() == 2


def test_many_writers_lose_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    work = [threading.Thread(target=lambda: [v.change("n", lambda s: {"x": (s or {"x": 0})["x"] + 1}) for _ in range(10)]) for _ in range(4)]
    [t.start() for t in work]
    [t.join() for t in work]
    assert v.latest("n") == (40, {"x": 40})


def test_two_appends_at_once(spark, tmp_path):
    st = IO.DatasetStore(spark, str(tmp_path / "store"))
    st.import_rows(spark.range(3).toDF("k"), "o", "d", "d.csv")
    errors = []

    def writer(kind):
        try:
            for i in range(3):
                more = spark.range(10).select(F.col("id").alias("k"), F.lit(i).cast(kind).alias("extra"))
                IO.DatasetStore(spark, str(tmp_path / "store")).import_rows(more, "o", "d", "d.csv", "append", problem_count=1, problem_samples=[kind])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    work = [threading.Thread(target=writer, args=(k,)) for k in ("int", "string")]
    [t.start() for t in work]
    [t.join() for t in work]
    assert not errors
    meta = st.meta("o", "d")
    assert len(meta["parts"]) == 7 and meta["row_count"] == 63 and meta["problem_count"] == 6 and len(meta["problem_samples"]) == 6
    rows = st.read("o", "d")
    assert rows.count() == 63 and rows.filter("extra is not null").count() == 60  # both writers' values, in the type that was first
    assert st.list("o").first()["row_count"] == 63


def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch):
    st = IO.DatasetStore(spark, str(tmp_path / "store"))
    st.import_rows(spark.range(3), "o", "d", "d.csv")
    for step in ("put", "change"):
        monkeypatch.setattr(st.states, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("crash")))
        for mode in ("append", "replace"):
            with pytest.raises(RuntimeError):
                st.import_rows(spark.range(5), "o", "d", "d.csv", mode)
        monkeypatch.undo()
        assert st.read("o", "d").count() == 3
    st.import_rows(spark.range(5), "o", "d", "d.csv", "append")
    assert st.read("o", "d").count() == 8


def test_results_switch_at_once(spark, tmp_path, monkeypatch):
    rs = IO.ResultStore(spark, str(tmp_path / "results"))
    with pytest.raises(KeyError):
        rs.read("cards")
    rows = lambda xs: spark.createDataFrame(xs, "dataset_id string, v int")
    rs.put({"cards": rows([("a", 1), ("b/é", 2)]), "points": rows([("a", 10), ("a", 11)])}, ["a", "b/é"])
    got = lambda t, d=None: sorted(tuple(r) for r in rs.read(t, d).collect())
    assert got("cards") == [("a", 1), ("b/é", 2)] and got("points", "a") == [("a", 10), ("a", 11)] and got("points", "b/é") == []
    rs.put({"cards": rows([("a", 5), ("zz", 9)])}, ["a"])  # zz is not named; points stay
    assert got("cards") == [("a", 5), ("b/é", 2)] and got("points") == [("a", 10), ("a", 11)]
    rs.put({"cards": rows([])}, ["b/é"])
    assert got("cards") == [("a", 5)]
    monkeypatch.setattr(rs.states, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        rs.put({"cards": rows([("a", 7)]), "points": rows([("a", 77)])}, ["a"])
    monkeypatch.undo()
    assert got("cards") == [("a", 5)] and got("points", "a") == [("a", 10), ("a", 11)]


EXACT = ["ordinal", "column", "kind", "rows", "missing", "non_empty", "n_email", "n_phone", "n_numeric", "n_date", "n_boolean", "ui_integer", "st_number", "num_min", "num_max",
         "num_count", "len_sum", "date_min", "date_max", "type", "detected_type", "metadata_type", "strict_type", "fine_type", "samples", "missing_pct", "null_ratio"]


def same_profile(got, want, error=0.02):
    got, want = ({r["column"]: r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert {k: got[c][k] for k in EXACT} == {k: w[k] for k in EXACT}, c
        for k in ("distinct_ci", "distinct_raw"):
            assert abs(got[c][k] - w[k]) <= error * w[k], (c, k)


def test_profile_after_appends(spark, tmp_path):
    """Equal to the profile of all rows, and old parts are not read again."""
    st = IO.DatasetStore(spark, str(tmp_path / "store"))
    o = table(spark, SF, "orders").select("*", F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("code"), F.lit(None).cast("string").alias("empty"))
    first, second, third = o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 3 = 1").drop("code"), o.filter("o_orderkey % 3 = 2").withColumn("late", F.lit("x"))
    st.import_rows(first, "o", "orders", "o.csv")
    st.import_rows(second, "o", "orders", "o.csv", "append")
    same_profile(st.profile("o", "orders"), PF.profile(st.read("o", "orders")))
    seen = st.meta("o", "orders")["parts"]
    whole = st.read("o", "orders").unionByName(third, allowMissingColumns=True).collect()
    schema = first.withColumn("late", F.when(F.col("code") != "", "x")).schema
    for part in seen:  # what cannot be read any more is not read
        IO.delete_folder(spark, part)
    st.import_rows(third, "o", "orders", "o.csv", "append")
    got = st.profile("o", "orders")
    same_profile(got, PF.profile(spark.createDataFrame(whole, schema)))
    price = sorted(r.o_totalprice for r in whole)
    median = {r["column"]: r["num_median"] for r in got.collect()}["o_totalprice"]
    rank = sum(p <= median for p in price) / len(price)
    assert abs(rank - 0.5) < 0.03


def test_profile_state_of_odd_parts(spark, tmp_path):
    st = IO.DatasetStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(None, " ", 1), ("a", "A", None), ("a ", "yes", 3)], "s string, t string, n int")
    st.import_rows(df.limit(0), "o", "d", "d.csv")
    empty = {r["column"]: (r["rows"], r["non_empty"], r["distinct_raw"], r["type"], r["samples"]) for r in st.profile("o", "d").collect()}
    assert empty == {c: (0, 0, 0, "text", []) for c in ("s", "t", "n")}
    st.import_rows(df, "o", "d", "d.csv", "append")
    st.import_rows(df, "o", "d", "d.csv", "append")
    same_profile(st.profile("o", "d"), PF.profile(df.union(df)), 0)
    state = PS.merged(PS.part_state(df).unionByName(PS.part_state(df)))
    assert {f.name for f in state.schema.fields} == {f.name for f in PS.STATE.fields}
    nested = spark.createDataFrame([([1],)], "a array<int>")
    assert PS.part_state(nested).collect()[0]["rows"] == 1 and PS.profile_of(PS.part_state(nested), nested.schema).collect() == []
