from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from chronofold.streaming import streams

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_streams_over_two_deliveries(spark, tmp_path):
    p = str(tmp_path / "events.parquet")
    rows = [("k1", T0), ("k1", T0 + timedelta(minutes=1)), ("k2", T0 + timedelta(hours=30))]
    spark.createDataFrame(rows, "key string, ts timestamp").repartition(1).write.parquet(p)
    first = streams.run_once(streams.first_per_key(streams.read(spark, p, "ts"), ["key"]).select("key"))
    assert sorted(r[0] for r in first.collect()) == ["k1", "k2"]
    n = streams.run_once(streams.counts_per_window(streams.read(spark, p, "ts"), "ts", "1 day", ["key"]), "complete")
    assert sorted((r["key"], r["n"]) for r in n.collect()) == [("k1", 2), ("k2", 1)]
    s = streams.run_once(streams.sessions(streams.read(spark, p, "ts"), "ts", "5 minutes", ["key"]), "complete")
    assert {(r["key"], r["n"]) for r in s.collect()} == {("k1", 2), ("k2", 1)}


def test_transitions_and_timers(spark, tmp_path):
    p = str(tmp_path / "history.parquet")
    rows = [("t", "w", 1, "uninitialized", "a", T0), ("t", "w", 2, "a", "b", T0), ("t", "w", 2, "a", "b", T0), ("t", "w", 3, "zzz", "c", T0)]
    spark.createDataFrame(rows, "tenant_id string, instance_id string, revision int, prior_state string, new_state string, created_at timestamp").write.parquet(p)
    got = streams.run_once(streams.transitions(streams.read(spark, p, "created_at")))
    assert sorted((r["revision"], r["accepted"]) for r in got.collect()) == [(1, True), (2, True), (3, False)]
    q = str(tmp_path / "holds.parquet")
    holds = [("kept", T0, "hold"), ("expired", T0, "hold"), ("kept", T0 + timedelta(seconds=30), "pay"), ("late", T0 + timedelta(hours=9), "hold")]
    spark.createDataFrame(holds, "key string, ts timestamp, what string").repartition(1).write.parquet(q)
    due = streams.run_once(streams.expiries(streams.read(spark, q, "ts", "1 minute"), "ts", 60, "key", "what = 'pay'"))
    assert [(r["key"], r["due_us"]) for r in due.where(F.col("key") != "late").collect()] == [("expired", round((T0 + timedelta(seconds=60)).timestamp() * 1e6))]
