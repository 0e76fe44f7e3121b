"""Registered ingestion / store queries (S1, S5, S7, S9, S13) with oracles.

The CSV round trip writes a table as CSV into the shared checkpoint folder
(a folder the cluster names), reads it back as all-string cells, infers the
column types with the profile job and casts (S7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import periods as PD
from ..operators import profile as PF
from ..session import ensure_checkpoint_dir
from ..sources import io as IO
from ..sources.tables import table
from .catalog_queries import register


@register("s09_append", """
SELECT * FROM orders
""")
def s09_append(spark, base):
    o = table(spark, base, "orders")
    mid = PD.period_bounds_scalar(o, "o_orderdate").getField("current_start")
    first = o.filter(F.col("o_orderdate") < mid)
    second = o.filter(~(F.col("o_orderdate") < mid) | F.col("o_orderdate").isNull())
    return IO.append_rows(first, second.select(*reversed(second.columns)))


@register("s01_csv_roundtrip", """
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
       c_acctbal, c_mktsegment
FROM customer
""")
def s01_csv_roundtrip(spark, base):
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    table(spark, base, "customer").write.mode("overwrite").option("header", True).csv(folder)
    raw = IO.read_csv(spark, folder)
    types = IO.types_from_profile(PF.profile(raw, with_samples=False))
    return IO.cast_to_schema(raw, types)


# ------------------------------------------------------------------ store

def _store(spark):
    return IO.DatasetStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


@register("s03_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50")
def s03_preview(spark, base):
    st = _store(spark)
    st.import_rows(table(spark, base, "nation"), "org", "nation", "nation.csv")
    st.import_rows(table(spark, base, "customer"), "org", "customer", "customer.csv", "preview")
    return st.read("org", "customer", IO.PREVIEW_ROWS, "c_custkey")


@register("s11_other_schema", """
SELECT 'first' AS org, CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation
UNION ALL SELECT 'second', CAST(r_regionkey AS BIGINT), r_name FROM region
""")
def s11_other_schema(spark, base):
    """Two organisations use one dataset id for data of different schemas."""
    st = _store(spark)
    st.import_rows(table(spark, base, "nation"), "first", "data", "nation.csv")
    st.import_rows(table(spark, base, "region"), "second", "data", "region.csv")
    a, b = st.read("first", "data"), st.read("second", "data")
    return (a.select(F.lit("first").alias("org"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
            .unionByName(b.select(F.lit("second").alias("org"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))))


@register("s08_replace", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def s08_replace(spark, base):
    st, o = _store(spark), table(spark, base, "orders")
    st.import_rows(o, "org", "orders", "orders.csv")
    st.import_rows(o.filter("o_orderstatus = 'O'"), "org", "orders", "orders.csv", "replace")
    return st.read("org", "orders")


@register("s08_append", """
SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation
UNION ALL SELECT NULL, NULL, r_regionkey, r_name FROM region
""")
def s08_append(spark, base):
    """Append rows that lack two columns and bring a new one."""
    st = _store(spark)
    st.import_rows(table(spark, base, "nation").select("n_nationkey", "n_name", "n_regionkey"), "org", "places", "nation.csv")
    more = table(spark, base, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    st.import_rows(more, "org", "places", "region.csv", "append")
    return st.read("org", "places")


@register("s04_list", """
SELECT 'customer' AS dataset_id, (SELECT COUNT(*) FROM customer) AS row_count, 5 AS n_columns, 'preview' AS status, 0 AS problem_count
UNION ALL SELECT 'emptied', 0, 3, 'confirmed', 0
UNION ALL SELECT 'twice', 2 * (SELECT COUNT(*) FROM region), 2, 'confirmed', 7
""")
def s04_list(spark, base):
    """S4 after S8 (confirm, preview, append, replace with no rows) and S10."""
    st = _store(spark)
    region, nation = table(spark, base, "region").select("r_regionkey", "r_name"), table(spark, base, "nation").select("n_nationkey", "n_name", "n_regionkey")
    st.import_rows(table(spark, base, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "org", "customer", "c.csv", "preview")
    st.import_rows(region, "org", "twice", "r.csv", problem_count=3, problem_samples=["a", "b"])
    st.import_rows(region, "org", "twice", "r.csv", "append", problem_count=4, problem_samples=["c"])
    st.import_rows(nation, "org", "emptied", "n.csv")
    st.import_rows(nation.filter("n_nationkey < 0"), "org", "emptied", "n.csv", "replace")
    st.import_rows(nation, "org", "dropped", "n.csv")
    st.delete("org", "dropped")
    st.import_rows(nation, "other", "not listed", "n.csv")
    return st.list("org").select("dataset_id", "row_count", F.size("columns").alias("n_columns"), "status", "problem_count")


@register("s10_delete", "SELECT * FROM region")
def s10_delete(spark, base):
    """Delete one dataset; the other's rows stay."""
    st = _store(spark)
    st.import_rows(table(spark, base, "region"), "org", "kept", "r.csv")
    st.import_rows(table(spark, base, "nation"), "org", "gone", "n.csv")
    st.delete("org", "gone")
    kept = st.read("org", "kept")
    return kept.filter(F.lit(st.meta("org", "gone") is None))


@register("s12_persist", """
SELECT o_orderstatus AS dataset_id, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1
UNION ALL SELECT 'F', -1
""")
def s12_persist(spark, base):
    """Replace the results of F and O; O has no new rows, P is not named."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    first = table(spark, base, "orders").groupBy(F.col("o_orderstatus").alias("dataset_id")).agg(F.count("*").alias("n"))
    IO.persist_results(first, path, ["F", "O", "P"])
    IO.persist_results(first.filter("dataset_id = 'F'").withColumn("n", F.lit(-1).cast("long")), path, ["F", "O"])
    return IO.read_results(spark, path).select("dataset_id", "n")


@register("s13_export", """
SELECT strftime(o_orderdate, '%Y') AS x, CAST(SUM(o_totalprice) AS DOUBLE) AS y, COUNT(*) AS n FROM orders
WHERE o_orderdate IS NOT NULL GROUP BY 1
""")
def s13_export(spark, base):
    from ..operators import series as SR
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    IO.export_series_csv(SR.temporal_series(table(spark, base, "orders"), "o_orderdate", "o_totalprice", "sum", "year"), path)
    back = IO.read_csv(spark, path)
    return back.select("x", F.col("y").cast("double").alias("y"), F.col("n").cast("long").alias("n"))


@register("s02_typed_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s02_typed_csv(spark, base):
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    t = table(spark, base, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    t.write.option("header", True).csv(folder)
    back = IO.read_csv_typed(spark, folder)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.schema.fields])
