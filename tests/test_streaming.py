"""The live daily series equals the batch daily series once all files are
processed (complete output mode)."""

from tabulon.operators import series as SR
from tabulon.operators.rules import Rule, rule_alerts
from tabulon.sources.tables import table
from tabulon.streaming import live

SF = "/root/testdata/sf0.001"


def test_live_daily_series(spark):
    batch = table(spark, SF, "events")
    stream = live.event_stream(spark, SF, batch.schema, file_glob="events.parquet")
    out = live.run_available(live.windowed_series(stream, "ts", "value", "sum"), "live_daily", mode="complete")
    got = {r["x"]: (round(r["y"], 6), r["n"]) for r in out.collect()}
    want = {r["x"]: (round(r["y"], 6), r["n"])
            for r in SR.temporal_series(batch, "ts", "value", "sum", "day").collect()}
    assert got == want


def test_live_alerts(spark):
    batch = table(spark, SF, "events")
    stream = live.event_stream(spark, SF, batch.schema, file_glob="events.parquet")
    rules = [Rule("big", "Big value", "value", 10.0, ">")]
    out = live.run_available(live.windowed_alerts(stream, "ts", rules), "live_alerts", mode="complete")
    total = sum(r["triggered_count"] for r in out.collect())
    assert total == rule_alerts(batch, rules).first()["triggered_count"]
