"""Values far beyond the sample tables: magnitudes, lengths and names."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import predicates as P
from tabulon.operators import analysis as AN
from tabulon.operators import filters as FL
from tabulon.operators import profile as PF
from tabulon.operators import series as SR
from tabulon.operators import stats as ST
from tabulon.plans.recommend import semantics as S
from tabulon.sources import io as IO


def test_rounding_at_any_magnitude(spark):
    xs = [1e17, -1e17, 3e15, -3e15, 9.3e18, 1e300, 2.5, -2.5, 1.005, 0.0, float("inf"), None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", P.js_round("x", 2).alias("r2"), P.js_round("x", 4).alias("r4")).collect()
    for r in rows:
        if r.x is None or abs(r.x) >= 3e15:
            assert r.r2 == r.x and r.r4 == r.x
    assert [r.r2 for r in rows[6:9]] == [2.5, -2.5, 1.0]
    df = spark.createDataFrame([("a", 3e17), ("a", 5e16)], "g string, v double")
    assert [r[1] for r in AN.group_by(df, "g", "v", "sum").collect()] == [3.5e17]


def test_long_urls_and_texts(spark):
    urls = [f"https://example.com/{'a' * 3000}?q={i}" for i in range(5)] + ["sub." * 2000 + "example.com/x"]
    df = spark.createDataFrame([(u, "x" * 50_000, "2024-01-0%d" % (i + 1)) for i, u in enumerate(urls)], "u string, prose string, d string")
    p = {r["column"]: r for r in PF.profile(df).collect()}
    assert p["u"]["n_url"] == 6 and p["prose"]["n_url"] == 0 and p["d"]["n_date"] == 6
    assert p["d"]["samples"] == sorted(p["d"]["samples"]) and len(p["prose"]["samples"]) == 1


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_one_profile_at_every_partitioning(spark, parts):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"), F.concat(F.lit("V"), F.col("id") % 2).alias("t")).repartition(parts)
    got = [(r["column"], r["distinct_raw"], r["distinct_ci"], r["samples"]) for r in PF.profile(df).orderBy("ordinal").collect()]
    assert [g[:3] for g in got] == [("id", 3000, 3000), ("s", 7, 7), ("t", 2, 2)]
    assert got[1][3] == sorted(got[1][3])
    plan = PF.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_names_that_hold_personal_data(spark):
    names = ["ip_address", "is_weekend", "id_type", "device_id", "at_risk"]
    prof = spark.createDataFrame([("ds", i, n, "categorical", 0.0, 0.1, 5, "low", 0.0) for i, n in enumerate(names)],
                                 "dataset_id string, ordinal int, column string, type string, null_ratio double, unique_ratio double, "
                                 "cardinality_count long, cardinality_class string, missing_pct double")
    got = {r["column"]: (r["semantic_role"], r["is_sensitive"]) for r in S.classify(prof).collect()}
    assert got["ip_address"] == (S.SENSITIVE, True)
    assert got["is_weekend"][0] == S.STATUS and got["id_type"][0] == S.IDENTIFIER


def test_quoted_newlines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n2,"say ""hi"""\n\n')
    rows = IO.read_csv(spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b) for r in rows) == [("1", "two\nlines"), ("2", 'say "hi"')]


def test_store_keeps_datasets_apart(spark, tmp_path):
    st = IO.DatasetStore(spark, str(tmp_path / "store"))
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2.5, True)], "c double, d boolean")
    st.import_rows(a, "o", "A/1", "a.csv")
    st.import_rows(b, "o", "B", "b.csv")
    assert st.read("o", "A/1").collect() == a.collect() and st.read("o", "B").collect() == b.collect()
    st.import_rows(a.limit(0), "o", "A/1", "a.csv", "replace")
    assert st.read("o", "A/1").count() == 0 and st.meta("o", "A/1")["row_count"] == 0
    st.delete("o", "B")
    with pytest.raises(KeyError):
        st.read("o", "B")
    assert [r.dataset_id for r in st.list("o").collect()] == ["A/1"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "catalog").write_text("no parquet")
    with pytest.raises(Exception):
        IO.DatasetStore(spark, str(tmp_path / "broken")).catalog().collect()


def test_filter_values_of_another_type(spark):
    df = spark.createDataFrame([(1, 1.5, "x", True)], "i long, d double, s string, b boolean")
    for filters, n in (({"i": "abc"}, 0), ({"i": "1"}, 1), ({"i": 1.5}, 0), ({"d": "1.5"}, 1), ({"d": "z"}, 0), ({"s": 5}, 0), ({"b": "true"}, 1), ({"b": "maybe"}, 0)):
        assert FL.equality_filters(df, filters).count() == n, filters


def test_wide_correlation(spark):
    df = spark.range(100).select(*[(F.pmod(F.col("id") * (i + 3), F.lit(17 + i)) + 0.0).alias(f"c{i}") for i in range(79)], F.lit(4.0).alias("flat"))
    rows = ST.correlation_matrix(df, df.columns).collect()
    r = {(x.variable, x.other): x.correlation for x in rows}
    assert len(r) == 6400 and r["c1", "c1"] == 1.0 and r["flat", "flat"] == 0.0 and r["c1", "flat"] == 0.0 and r["c1", "c2"] == r["c2", "c1"]


def test_exact_medians(spark):
    df = spark.range(100_001).select(F.when(F.col("id") < 4, F.lit(None)).otherwise(F.lit("g")).alias("k"), (F.col("id") * 7919 % 100_001 + 0.0).alias("v"))
    got = {r.k: (r.lower, r.upper) for r in SR.group_medians(df, ["k"], "v").collect()}
    vs = sorted(i * 7919 % 100_001 for i in range(4, 100_001))
    few = sorted(i * 7919 % 100_001 for i in range(4))
    assert got["g"] == (vs[len(vs) // 2 - (len(vs) % 2 == 0)], vs[len(vs) // 2]) and got[None] == (few[1], few[2])
    assert [r.lower for r in SR.group_medians(df.limit(0), [], "v").collect()] == [None]


def test_samples_of_values_that_share_a_hash_class(spark):
    """Up to five distinct values, also where their classes collide."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderpriority")
    assert PF.profile(orders).first()["samples"] == ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    df = spark.range(2000).select(*[F.concat(F.lit("v"), F.col("id") % n).alias(f"c{n}") for n in (1, 2, 3, 4, 5, 40)], F.lit(None).cast("string").alias("none"))
    got = {r["column"]: r["samples"] for r in PF.profile(df).collect()}
    assert all(got[f"c{n}"] == [f"v{i}" for i in range(n)] for n in (1, 2, 3, 4, 5)) and len(set(got["c40"])) == 5 and got["none"] == []
