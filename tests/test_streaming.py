from __future__ import annotations

from riskgraph.streaming import decide, velocity

EVENTS = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def drained(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_count_every_event_once(spark):
    events = velocity.event_stream(spark, EVENTS, SCHEMA, "events.parquet")
    rows = drained(velocity.velocity(velocity.once(events), window="30 minutes", late=None), "velocity")
    batch = spark.read.parquet(f"{EVENTS}/events.parquet")
    assert 0 < sum(r.n for r in rows.collect()) <= batch.count()


def test_budget_over_a_stream(spark, tmp_path):
    spark.createDataFrame([("bot", i, 100 + i, "FULL_FREEZE") for i in range(5)], "actor string, seq long, ts_s long, action string").coalesce(1).write.parquet(str(tmp_path / "in"))
    requests = spark.readStream.schema("actor string, seq long, ts_s long, action string").parquet(str(tmp_path / "in"))
    rows = drained(decide.freeze_budget(requests, budget=2), "budget").collect()
    assert sorted((r.seq, r.granted) for r in rows) == [(0, True), (1, True), (2, False), (3, False), (4, False)]


def test_sessions_close_after_a_gap(spark, tmp_path):
    at = [0, 100, 200, 9000, 9100, 90_000]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(at)], "event_id long, s long, user_id long").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drained(velocity.sessions(stream, gap="30 minutes"), "sessions").collect()
    # the last session is still open
    assert sorted(r.n for r in got) == [2, 3]


def test_an_event_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, 100 + i) for i in range(9)], "event_id long, s long").selectExpr("event_id", "timestamp_seconds(s) AS ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert drained(velocity.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "once").count() == 3


def test_decisions_on_a_stream(spark, tmp_path):
    schema = "txn_id string, ts_s long, src long, dst long, paise long, channel string, device string, ip string, ben_age double"
    rows = spark.createDataFrame([("t1", 1, 1, 2, 3_000_000, "UPI", None, None, 0.2), ("t2", 2, 2, -1, 100, "ATM", None, None, 50.0), ("t3", 3, 8, 9, 100, "UPI", None, None, None)], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    risk = spark.createDataFrame([(1, 10.0), (2, 70.0)], "account long, risk double")
    got = {r.txn_id: r for r in drained(velocity.decide(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), risk), "decided").collect()}
    assert (got["t1"].score, got["t1"].action, got["t1"].reasons) == (88.0, "BLOCK", "HIGH_RISK_BENEFICIARY,FRESH_BENEFICIARY")
    assert (got["t2"].score, got["t2"].reasons) == (70 * 0.35 + 12, "CASH_OUT_ATTEMPT") and got["t3"].action == "ALLOW"
