from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from chronofold.operators import intake

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def h(n):
    return None if n is None else T0 + timedelta(hours=n)


def test_artifacts_are_immutable(spark):
    cols = "tenant_id string, artifact_id string, content string, media_type string, source_identity string, created_at timestamp"
    rows = [("t", "a", "x", "m", "s", h(0)), ("t", "a", "x", "m", "s", h(1)), ("t", "b", "x", "m", "s", h(0)), ("t", "b", "y", "m", "s", h(1)), ("t", "c", "z", "m", "s", h(0)), ("t", None, "q", "m", "s", h(0)), ("t", None, "q", "m", "s", h(2)), ("t", "old", "n", "m", "s", h(0))]
    ledger = spark.createDataFrame([("t", "old", "sha", "m", "s")], "tenant_id string, artifact_id string, content_hash string, media_type string, source_identity string")
    got = {r["artifact_id"]: r["outcome"] for r in intake.put_artifacts(spark.createDataFrame(rows, cols), ledger).collect()}
    made = next(k for k in got if k.startswith("artifact_"))
    assert len(made) == len("artifact_") + 24
    assert got == {"a": "replayed", "b": "conflict", "c": "inserted", made: "replayed", "old": "conflict"}


def test_assertion_rules(spark):
    cols = "tenant_id string, assertion_id string, subject_entity_id string, predicate string, perspective string, valid_from timestamp, valid_to timestamp, system_from timestamp, system_to timestamp, authority int, strength_type string, strength_json string, source_artifact_id string, supersedes_assertion_id string"

    def row(i, valid_to=None, authority=50, strength=("none", "{}"), source=None, up=None, subject="s", system=5, system_to=None):
        return ("t", i, subject, "p", "o", h(0), h(valid_to), h(system), h(system_to), authority, *strength, source, up)

    ledger = spark.createDataFrame([row("open"), row("closed", system_to=5), row("young", system=50)], cols)
    reqs = [
        (row("ok", up="open", source="art", system=9), None),
        (row("r1", valid_to=-1), "valid interval"),
        (row("r2", authority=101), "authority"),
        (row("r3", strength=("probability", '{"value":1.5}')), "strength"),
        (row("r4", strength=("interval", '{"low":3,"high":2}')), "strength"),
        (row("r5", source="nope"), "source not found"),
        (row("r6", source="gone"), "source deleted"),
        (row("r7", up="nope"), "predecessor not found"),
        (row("r8", up="open", subject="other"), "predecessor of another claim"),
        (row("r9", up="closed", system=9), "predecessor not open"),
        (row("r10", up="young"), "predecessor not open"),
    ]
    art = spark.createDataFrame([("t", "art", "active"), ("t", "gone", "deleted")], "tenant_id string, artifact_id string, status string")
    got = intake.with_status(intake.check_assertions(spark.createDataFrame([r for r, _ in reqs], cols), ledger, art)).collect()
    assert {r["assertion_id"]: r["error"] for r in got} == {r[1]: e for r, e in reqs}
    assert {r["assertion_id"] for r in got if r["status_"] == "accepted"} == {"ok"}


def test_lineage_rules(spark):
    cols = "tenant_id string, edge_id string, relation string, src string, dst string"
    rows = [("t", "1", "supports", "assertion:a", "assertion:b"), ("t", "1", "supports", "assertion:a", "assertion:b"), ("t", "2", "supports", "assertion:a", "assertion:a"), ("t", "3", "supports", "artifact:a", "assertion:b"), ("t", "4", "likes", "assertion:a", "assertion:b"), ("t", "5", "governs", "assertion:a", "effect:e")]
    df = spark.createDataFrame(rows, cols)
    assert {r["edge_id"]: r["error"] for r in intake.check_lineage(df).collect()} == {"1": None, "2": "self edge", "3": "wrong ends", "4": "unknown relation", "5": None}
    assert [r["edge_id"] for r in intake.new_edges(df, df.where("edge_id = '5'")).collect()] == ["1"]


def test_replays_permissions_and_timers(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("m", 1, "a")], "k string, n int, b string")
    got = {(r["k"], r["n"]): r["outcome"] for r in intake.replays(df, ["k"], ["n"], F.col("b")).collect()}
    assert got == {("k", 1): "executed", ("k", 2): "replayed", ("k", 3): "conflict", ("m", 1): "executed"}
    keys = spark.createDataFrame([("t", "p", ["read"], ["ops"], None, None), ("t", "late", ["read"], ["ops"], h(1), None)], "tenant_id string, principal_id string, scopes array<string>, purposes array<string>, expires_at timestamp, revoked_at timestamp")
    calls = spark.createDataFrame([("t", "p", "search", "ops", h(2)), ("t", "p", "assert", "ops", h(2)), ("t", "late", "search", "ops", h(2)), ("t", "none", "search", "ops", h(2))], "tenant_id string, principal_id string, operation string, purpose string, at timestamp")
    ok = {(r["principal_id"], r["operation"]): r["allowed"] for r in intake.permitted(calls, keys, {"search": "read", "assert": "write"}).collect()}
    assert ok == {("p", "search"): True, ("p", "assert"): False, ("late", "search"): False, ("none", "search"): False}
    timers = spark.createDataFrame([(f"t{i:03d}", "pending", 5) for i in range(101)] + [("x", "fired", 1), ("y", "pending", 9)], "timer_id string, status string, due_at int")
    assert intake.due_timers(timers, F.lit(5)).count() == 100 and intake.due_timers(timers, F.lit(5), None).count() == 101
