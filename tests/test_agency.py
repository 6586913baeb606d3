"""Folds of commands, attempts and budgets, leases, permissions, records and traces."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronofold import session
from chronofold.operators import agency, intake
from chronofold.plans.sqlguard import UnsafeQuery, read_sql

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
COMMANDS = "tenant_id string, instance_id string, revision int, prior_state string, new_state string, event_id string, x int"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def test_a_rejected_command_changes_nothing(spark):
    rows = [("t", "w", 1, "none", "a", "e1", 1), ("t", "w", 2, "stale", "z", "e2", 1), ("t", "w", 2, "a", "b", "e3", 1), ("t", "w", 2, "a", "c", "e4", 1), ("t", "w", 3, "b", "d", "e5", 1), ("t", "w", 3, "b", "d", "e5", 1), ("t", "v", 2, "a", "b", "e6", 1), ("t", "w", None, "d", "f", "e0", 1), (None, "w", 1, "a", "b", "e", 1)]
    df = spark.createDataFrame(rows, COMMANDS)
    got = {r["event_id"]: r["accepted"] for r in agency.transitions(df, ["revision", "event_id"]).collect()}
    assert got == {"e1": True, "e2": False, "e3": True, "e4": False, "e5": True, "e6": False, "e0": False}
    assert agency.transitions(df.limit(0), ["revision"]).count() == 0


def test_attempts_go_from_delivery_to_reconciliation(spark):
    rows = [("e", i, o) for i, o in enumerate(["unknown", "unknown", "unknown", None, "succeeded", "failed"])] + [("f", 0, "failed")]
    got = agency.attempts(spark.createDataFrame(rows, "k string, n int, o string"), ["k"], ["n"], "o", 2).orderBy("k", "n").collect()
    assert [(r["attempt_number"], r["status"], r["attempt_count"], r["reconciliation_count"], r["delay_s"]) for r in got] == [(1, "unknown", 1, 0, 30), (2, "reconciling", 2, 0, 30), (3, "reconciling", 2, 1, 60), (4, "reconciling", 2, 2, 120), (5, "succeeded", 2, 3, 0), (None, "succeeded", 2, 3, 0), (1, "failed", 1, 0, 0)]


def test_budget_is_reserved_and_settled(spark):
    cols = "tenant_id string, effect_id string, currency string, budget_amount decimal(20,4), status string, created_at timestamp, updated_at timestamp"
    amount = Decimal("6.0000")
    rows = [("t", "a", "C", amount, "failed", at(0), at(3)), ("t", "b", "C", amount, "succeeded", at(1), at(2)), ("t", "c", "C", amount, "succeeded", at(4), at(5)), ("t", "d", "C", amount, "planned", at(6), at(6)), ("t", "a", "C", amount, "failed", at(0), at(3)), ("t", "n", None, amount, "planned", at(0), at(0))]
    got = agency.budget_steps(spark.createDataFrame(rows, cols), 100_000).orderBy("at_us", "settles", "effect_id").collect()
    assert [(r["effect_id"], r["settles"], r["admitted"], r["reserved"], r["spent"]) for r in got] == [("a", False, True, 60_000, 0), ("b", False, False, 60_000, 0), ("b", True, None, 60_000, 0), ("a", True, None, 0, 0), ("c", False, True, 60_000, 0), ("c", True, None, 0, 60_000), ("d", False, False, 0, 60_000)]


def test_a_lease_that_ran_out_is_taken_over(spark):
    cols = "tenant_id string, effect_id string, status string, attempt_count int, created_at timestamp, next_attempt_at timestamp, lease_expires_at timestamp"
    rows = [("t", "held", "dispatching", 1, at(0), at(0), at(9)), ("t", "lost", "dispatching", 1, at(1), at(0), at(4)), ("t", "new", "planned", 0, at(2), at(0), None), ("u", "later", "planned", 0, at(0), at(9), None), ("v", "done", "succeeded", 1, at(0), at(0), None), ("w", "tired", "unknown", 10, at(0), at(0), None)]
    got = {tuple(r) for r in agency.leasable(spark.createDataFrame(rows, cols), F.lit(at(5))).collect()}
    assert got == {("t", "lost", True), ("w", "tired", True)}


def test_effects_without_a_living_key_are_cancelled(spark):
    keys = spark.createDataFrame([("t", "k", ["effects:write"], ["*"], None, None), ("t", "old", ["effects:write"], ["p"], at(0), None), ("t", "gone", ["effects:write"], ["p"], None, at(0)), ("t", "read", ["facts:read"], ["p"], None, None), ("off", "k", ["effects:write"], ["*"], None, None)], "tenant_id string, key_id string, scopes array<string>, purposes array<string>, expires_at timestamp, revoked_at timestamp")
    tenants = spark.createDataFrame([("t", True), ("off", False)], "tenant_id string, active boolean")
    cases = [("t", "k", None, "kept"), ("t", "old", None, "cancelled"), ("t", "old", at(0), "kept"), ("t", "gone", None, "cancelled"), ("t", "read", None, "cancelled"), ("off", "k", None, "cancelled"), ("t", None, None, "cancelled")]
    e = spark.createDataFrame([(t, f"e{i}", "planned", k, "p", a) for i, (t, k, a, _) in enumerate(cases)] + [("t", "end", "failed", "gone", "p", None)], "tenant_id string, effect_id string, status string, key_id string, purpose string, authorized_at timestamp")
    got = {r["effect_id"]: r["outcome"] for r in agency.authorised(e, keys, tenants, F.lit(at(1))).collect()}
    assert got == {f"e{i}": c[3] for i, c in enumerate(cases)}


def test_turns_and_manifests(spark):
    df = spark.createDataFrame([("t", 'p"q', "r", "1", '{"a":1}', 1), ("t", 'p"q', "r", "1", '{"a":1}', 1), ("t", "p", "r", "2", '"' + "x" * 200 + '"', 1)], "tenant_id string, principal_id string, run_id string, turn_id string, body string, content int")
    got = sorted(agency.turn_records(df, 150).collect(), key=lambda r: r["error"] or "")
    assert len(got) == 2 and got[0]["content"] == '{"principal":{"principalId":"p\\"q","tenantId":"t"},"run":{"runId":"r"},"schemaVersion":1,"turn":{"a":1}}' and got[1]["error"] == "too long"
    m = lambda op: spark.range(1).select(agency.manifest(F.lit(op), assertions=F.lit("a"), artifacts=F.lit(None).cast("string"), effects=F.lit("e"), machines=F.lit("m"), edges=F.lit("l"))).first()[0]
    assert [m(x) for x in ("assert", "request_effect", "get_machine", "add_lineage", "put_entity")] == ['{"artifactIds":[],"assertionIds":["a"]}', '{"effectIds":["e"],"machineIds":["m"]}', '{"machineIds":["m"]}', '{"lineageEdgeIds":["l"]}', "{}"]


def test_lineage_needs_current_kinds_and_existing_ends(spark):
    day = "tenant_id string, assertion_id string, kind string, status string, valid_from timestamp, valid_to timestamp, system_from timestamp, system_to timestamp"
    a = spark.createDataFrame([("t", "d", "directive", "active", at(0), None, at(0), None), ("t", "old", "directive", "active", at(0), at(1), at(0), None), ("t", "o", "observation", "active", at(0), None, at(0), None), ("t", "c", "decision", "disputed", at(0), None, at(0), None)], day)
    nodes = spark.createDataFrame([("t", f"assertion:{x}") for x in ("d", "old", "o", "c")] + [("t", "effect:e")], "tenant_id string, node string")
    us = round(at(2).timestamp() * 1e6)
    cases = [("governs", "assertion:d", "effect:e", None), ("governs", "assertion:old", "effect:e", "not current"), ("governs", "assertion:o", "effect:e", "not current"), ("authorizes", "assertion:c", "effect:e", "not current"), ("verifies", "effect:e", "assertion:o", None), ("verifies", "effect:e", "assertion:d", "not current"), ("supports", "assertion:o", "assertion:gone", "target not found"), ("supports", "effect:e", "assertion:o", "wrong ends"), ("supports", "assertion:o", "assertion:o", "self edge")]
    e = spark.createDataFrame([("t", r, s, x, us, str(i)) for i, (r, s, x, _) in enumerate(cases)], "tenant_id string, relation string, src string, dst string, at_us bigint, edge_id string")
    assert {r["edge_id"]: r["error"] for r in agency.lineage_faults(e, nodes, a).collect()} == {str(i): c[3] for i, c in enumerate(cases)}
    assert intake.new_edges(e, e.where("edge_id = '0'")).where("edge_id = '0'").count() == 0


def test_guard_denies_calls_and_paths(spark):
    for bad in ("SELECT java_method('java.lang.System', 'exit', 0)", "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv . `/etc/passwd`"):
        with pytest.raises(UnsafeQuery):
            read_sql(spark, bad)
    assert read_sql(spark, "SELECT 'reflect(1) parquet.`x`' AS x").first()["x"] == "reflect(1) parquet.`x`"


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    Context.master = "local[2]"
    assert session.shared_folder(Session()).startswith("file://")
    folder = session.Scratch(spark, "some")
    folder.save(spark.range(3))
    session.release(spark)
    assert folder.root not in session._MADE
