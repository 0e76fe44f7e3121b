"""Every registered query runs on the smallest warehouse, and every query
with an SQL oracle matches it (row count, columns, order-free values)."""

import duckdb
import pytest

import __spark_entry__ as E
from tabulon.plans.registry import QUERIES
from tabulon.sources.tables import TABLES

import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle_check import digest  # noqa: E402

SF = "/root/testdata/sf0.001"

#: queries whose rules have no SQL oracle, with the rows they give on this
#: warehouse; their rules are tested on literal rows in the other modules
ROWS = {"g07_insights": 5, "p05_types": 15, "r03_business_roles": 62, "r11_domain_kpis": 19, "r12_domain_charts": 13, "r17_final_charts": 44, "r17_final_kpis": 39,
        "r18_best_chart": 14}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 4 and "kpi" in df.columns


OWN = {n: f for n, f in E.queries().items() if n in QUERIES}


def test_every_query_has_an_oracle_or_rows_to_check():
    assert set(OWN) - set(E.oracle_sql()) == set(ROWS)


@pytest.mark.parametrize("name", sorted(set(OWN) & set(E.oracle_sql())))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = OWN[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows(spark, name):
    df = OWN[name](spark, SF)
    rows = df.collect()
    assert len(rows) == ROWS[name] and len(set(map(str, rows))) == len(rows)
    for c in df.columns:  # a column of nulls alone would mean a rule that never fires
        if c not in ("limit", "direction", "period_type", "date_column", "rejected_reason", "relevance", "warning", "condition_test", "condition_values"):
            assert any(r[c] is not None for r in rows), c
