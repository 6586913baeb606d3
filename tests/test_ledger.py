"""Behaviour of the ledger operators on small tables."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalars as S
from chronofold.operators import audit, context, folds, graph, metrics, records, resolve, search, temporal
from chronofold.plans.sqlguard import UnsafeQuery, read_sql

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
COLS = "tenant_id string, assertion_id string, subject_entity_id string, predicate string, object_key string, object_json string, object_entity_id string, kind string, perspective string, valid_from timestamp, valid_to timestamp, system_from timestamp, system_to timestamp, authority int, status string, supersedes_assertion_id string, source_artifact_id string, strength_type string, strength_json string, extra string"


def claim(i, obj, authority=50, system=0, valid=0, valid_to=None, system_to=None, subject="s", up=None, status="active", entity=None, predicate="weight"):
    t = lambda h: None if h is None else T0 + timedelta(hours=h)
    return ("t", i, subject, predicate, obj, f'{{"type":"string","value":{obj}}}', entity, "observation", "organization", t(valid), t(valid_to), t(system), t(system_to), authority, status, up, None, "none", "{}", "x")


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def now(df, h=1000):
    return temporal.as_of(df, F.lit(T0 + timedelta(hours=h)))


def test_conflict_is_kept_and_policies_select(spark):
    df = frame(spark, [claim("a", '"3 l"', 70, 1), claim("b", '"4 l"', 60, 2)])
    none = resolve.resolve(now(df)).first()
    assert (none["status"], none["selected_assertion_id"], none["n_candidates"]) == ("conflicted", None, 2)
    assert resolve.resolve(now(df), "latest").first()["selected_assertion_id"] == "b"
    high = resolve.resolve(now(df), "highest_authority").first()
    assert (high["status"], high["selected_assertion_id"]) == ("resolved_with_conflict", "a")
    assert {r["assertion_id"] for r in resolve.conflicts(now(df), "highest_authority").collect()} == {"b"}
    assert resolve.conflicts(now(df)).count() == 2
    with pytest.raises(ValueError):
        resolve.resolve(df, "random")


def test_many_equal_claims_and_one_other(spark):
    rows = [claim(f"a{i}", '"x"', system=i) for i in range(501)]
    assert resolve.resolve(now(frame(spark, rows)), "highest_authority").first()["status"] == "known"
    r = resolve.resolve(now(frame(spark, rows + [claim("z", '"y"')]))).first()
    assert (r["status"], r["n_candidates"]) == ("conflicted", 502)


def test_revision_keeps_what_was_known(spark):
    df = frame(spark, [claim("old", '"Dublin"', system=0, system_to=10), claim("new", '"Seattle"', system=10, up="old")])
    assert [r["assertion_id"] for r in now(df, 5).collect()] == ["old"]
    assert [r["assertion_id"] for r in now(df, 10).collect()] == ["new"]
    assert resolve.resolve_claims(df, now(df, -1)).first()["status"] == "unknown"


def test_derived_system_to_and_faults(spark):
    df = frame(spark, [claim("a", "1"), claim("b", "2", system=5, up="a"), claim("c", "2", system=7, up="a"), claim("d", "3", up="gone"), claim("e", "3", up="e"), claim("f", "4", subject="other", system=9, up="a"), claim("g", "5", system=1, up="b")])
    to = {r["assertion_id"]: r["system_to_us"] for r in temporal.derived_system_to(df).collect()}
    assert to["a"] == round((T0 + timedelta(hours=5)).timestamp() * 1e6) and to["c"] is None
    assert {r["assertion_id"]: r["reason"] for r in temporal.supersession_faults(df).collect()} == {"d": "absent", "e": "self", "f": "other claim", "g": "later"}


def test_offsets_and_ids(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00+02:00", '{"b":1,"a":{"d":2,"c":[3]}}', "https://Api.Example:8443/x?y")], "t string, j string, u string")
    r = df.select(S.iso_utc("t"), S.canonical_json("j"), S.url_origin("u"), S.sha_parts("t", F.lit("x")), S.is_money(F.lit("12.3456")), S.is_money(F.lit("01"))).first()
    import hashlib

    assert r[0] == "2025-12-31T22:00:00.000Z" and r[1] == '{"a":{"c":[3],"d":2},"b":1}' and r[2] == "https://api.example:8443"
    assert r[3] == hashlib.sha256(b"2026-01-01T00:00:00+02:00\0x\0").hexdigest()
    assert (r[4], r[5]) == (True, False)


def test_feature_hash_forms_agree(spark):
    text = "the quick brown fox and the lazy dog and the fox"
    words = search.query_tokens(text)
    q = S.hash_vector(search.query_tokens("quick fox jumps"))
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = df.select(S.feature_hash(S.tokens("t")).alias("d"), S.hash_cosine(S.tokens("t"), q).alias("c")).collect()
    assert rows[0]["d"] == pytest.approx(S.hash_vector(words))
    assert rows[0]["c"] == pytest.approx(sum(a * b for a, b in zip(rows[0]["d"], q)))
    assert rows[1]["c"] == 0


def test_search_orders_by_score_and_distance(spark):
    df = frame(spark, [claim("link", '"customer:9"', subject="incident:1", entity="customer:9", predicate="affects"), claim("far", '"database error"', subject="service:x"), claim("near", '"database error"', subject="incident:1")])
    hits = [r["assertion_id"] for r in search.hybrid(now(df), "database error").collect()]
    assert hits == ["far", "near"]
    reached = graph.distances(graph.entity_edges(df), spark.createDataFrame([("t", "customer:9")], "tenant_id string, start string"), 2)
    top = search.hybrid(now(df), "database error", reached=reached).first()
    assert (top["assertion_id"], top["distance"]) == ("near", 1)


def test_distances_are_bounded_and_shortest(spark):
    chain = [claim(f"e{i}", f'"{i}"', subject=f"n{i}", entity=f"n{i + 1}") for i in range(12)] + [claim("short", '"s"', subject="n0", entity="n3")]
    e = graph.entity_edges(frame(spark, chain))
    s = spark.createDataFrame([("t", "n0")], "tenant_id string, start string")
    got = {r["node"]: r["distance"] for r in graph.distances(e, s, 99).collect()}
    assert got["n3"] == 1 and got["n2"] == 2 and max(got.values()) == 8
    assert graph.distances(e, s, 0).count() == 1


def test_trace_caps(spark):
    rows = [("t", "supports", f"assertion:a{i:03d}", "assertion:root", i, f"edge{i:03d}") for i in range(510)]
    e = spark.createDataFrame(rows, "tenant_id string, relation string, src string, dst string, at_us bigint, edge_id string")
    nodes, edges = graph.trace(spark, e, "t", "assertion:root", 1)
    assert (nodes.count(), edges.count()) == (500, 499)
    assert graph.render([("a\x07", 0), ("b", 1)]) == "a\\u0007\n  b"


def test_paging_over_equal_times(spark):
    df = spark.createDataFrame([(1, f"effect:{i:03d}") for i in range(101)], "t int, id string")
    first = records.page(df, ["t", "id"], 100).collect()
    last = first[-1]
    assert [r["id"] for r in records.page(df, ["t", "id"], 100, (last["t"], last["id"])).collect()] == ["effect:100"]
    assert records.page(df, ["t", "id"], None).count() == 101


def test_admission_consumes_nothing_when_rejected(spark):
    df = spark.createDataFrame([("p", i, q, 5) for i, q in enumerate([3, 4, None, 2, 1, -1])] + [("q", 0, 1, None)], "part string, n int, q bigint, cap bigint")
    got = {(r["part"], r["n"]): (r["admitted"], r["used"]) for r in folds.admit(df, ["part"], ["n"], "q", "cap").collect()}
    assert [got["p", i] for i in range(6)] == [(True, 3), (False, 3), (False, 3), (True, 5), (False, 5), (False, 5)]
    assert got["q", 0] == (False, 0)


def test_accepted_chain(spark):
    rows = [("t", "w", 1, "uninitialized", "a"), ("t", "w", 2, "a", "b"), ("t", "w", 2, "a", "b"), ("t", "w", 3, "x", "c"), ("t", "w", 4, "c", "d"), ("t", "v", 2, "a", "b")]
    got = {(r["instance_id"], r["revision"]): r["accepted"] for r in records.accepted_chain(spark.createDataFrame(rows, "tenant_id string, instance_id string, revision int, prior_state string, new_state string")).collect()}
    assert got == {("w", 1): True, ("w", 2): True, ("w", 3): False, ("w", 4): False, ("v", 2): False}


def test_metrics(spark):
    df = spark.createDataFrame([("a", x / 100) for x in range(1, 11)] + [("b", None)], "k string, v double")
    h = {(r["k"], r["le"]): r["n"] for r in metrics.histogram(df, ["k"], "v", [0.05, 1]).collect()}
    assert h == {("a", "0.05"): 5, ("a", "1"): 10, ("a", "+Inf"): 10, ("b", "0.05"): 0, ("b", "1"): 0, ("b", "+Inf"): 0}
    p = metrics.percentiles(df.where("k = 'a'"), ["k"], "v", {"p90": 0.9}).first()
    assert p["p90"] == 0.09 and p["median"] == pytest.approx(0.055)


def test_classification(spark):
    cases = [("deliver", 200, True, "succeeded"), ("deliver", 200, False, "unknown"), ("deliver", 404, True, "failed"), ("reconcile", 404, True, "unknown"), ("deliver", 429, True, "unknown"), ("deliver", 503, True, "unknown"), ("deliver", None, True, "unknown")]
    df = spark.createDataFrame(cases, "m string, c int, r boolean, want string")
    assert df.where(folds.classify(F.col("m"), F.col("c"), F.col("r")) != F.col("want")).count() == 0


def test_anti_join_and_violations(spark):
    df = frame(spark, [claim("a", "1", valid=5, valid_to=4), claim("a", "1", valid=5, valid_to=4), claim("b", "2", authority=101), claim("c", "3", up="c")])
    got = {r["rule"]: r["n"] for r in audit.violations(df).collect()}
    assert (got["valid interval"], got["authority"], got["self supersession"]) == (1, 1, 1)
    assert all(r["n"] == 0 for r in audit.violations(df.limit(0)).collect())


def test_context_fits_its_budget():
    sections = [("search", ["x" * 50] * 10), ("claims", ["y" * 900] * 10), ("trace", ["z"])]
    b = context.pack_context(sections, 2500)
    assert b["used"] <= 2500 and b["sections"][0]["complete"]
    assert context.pack_context([], 10)["sections"] == []
    many = context.pack_context([(str(i), "x" * 400) for i in range(100)], 1000)
    assert many["omitted"] and many["used"] <= 1000


def test_read_only_sql(spark):
    assert read_sql(spark, "SELECT ';' AS x -- ; drop").first()["x"] == ";"
    for bad in ("DELETE FROM x", "WITH a AS (SELECT 1) DELETE FROM b", "SELECT 1; DROP TABLE x", "INSERT INTO x VALUES (1)", "/* select */ DROP TABLE x"):
        with pytest.raises(UnsafeQuery):
            read_sql(spark, bad)


def test_files(spark, tmp_path):
    import hashlib

    from chronofold.sources import files

    good = hashlib.sha256(b"good").hexdigest()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / good).write_bytes(b"good")
    (tmp_path / "a" / ("0" * 64)).write_bytes(b"other")
    f = files.stored_artifacts(spark, str(tmp_path / "a"))
    assert [r["name"] for r in files.damaged_files(f).collect()] == ["0" * 64]
    known = spark.createDataFrame([(good,)], "content_hash string")
    assert [r["name"] for r in files.unreferenced_files(f, known, 2**62).collect()] == ["0" * 64]
    key = "00" * 32
    df = spark.createDataFrame([("secret é",)], "t string").withColumn("s", files.sealed("t", key))
    assert df.select(files.unsealed("s", key)).first()[0] == "secret é"
    (tmp_path / "r.json").write_text('{"requestId":"r1","operation":"assert",\n"input":{"a":1}}')
    e = files.envelopes(spark, str(tmp_path / "r.json")).first()
    assert (e["requestId"], e["input"]) == ("r1", '{"a":1}')
    files.write_lines(spark.createDataFrame([("x 1",)], "line string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == "x 1"


def test_search_reads_active_sources(spark):
    rows = spark.createDataFrame([("t", f"a{i}", f"s{i}", "has_state", '{"type":"string","value":"calm"}', "fact", "p", a) for i, a in enumerate(["live", "gone", None])], "tenant_id string, assertion_id string, subject_entity_id string, predicate string, object_json string, kind string, perspective string, source_artifact_id string")
    artifacts = spark.createDataFrame([("t", "live", "feed", "copper " + "x" * 4096 + " tin", "active"), ("t", "gone", "feed", "copper", "deleted"), ("u", "live", "feed", "tin", "active")], "tenant_id string, artifact_id string, source_identity string, content string, status string")
    df = search.with_sources(rows, artifacts)
    hit = lambda q: {r["assertion_id"] for r in search.scores(df, search.text_of(df), q).where("lexical > 0").collect()}
    assert df.count() == 3 and hit("copper") == hit("feed") == {"a0"} and hit("tin") == set() and hit("calm") == {"a0", "a1", "a2"}


def test_reachable_goes_two_hops(spark, tmp_path):
    from chronofold.plans import ledger

    rows = [claim(f"e{a}", f'"{b}"', subject=a, entity=b) for a, b in ("ab", "bc", "cd")]
    frame(spark, rows).write.parquet(str(tmp_path / "assertions.parquet"))
    got = {r["start"]: r["n_reached"] for r in ledger.graph_reachable(spark, str(tmp_path)).collect()}
    assert got == {"a": 3, "b": 4, "c": 4}


def test_nearest_in_blocks_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.integers(-3, 4, (120, 4)).astype(float)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (None, [1.0, 0.0, 0.0, 0.0]), (501, [0.0] * 4), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").selectExpr("*", "1 as key_", "2 as rank_")
    got = {(a, b): c for a, b, c in search.nearest_in_blocks(df.where("id % 10 = 0"), df, "id", "v", 7, rows_per_block=30, queries_per_block=5).collect()}
    ok = [i for i in range(120) if x[i].any()]
    want = {}
    for q in (i for i in ok if i % 10 == 0):
        sims = sorted((-(np.floor(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]) * 1e6 + 0.5) / 1e6), i) for i in ok)
        want |= {(q, i): -s for s, i in sims[:7]}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in got)
    assert search.nearest_in_blocks(df.limit(0), df, "id", "v", 3).count() == search.nearest_in_blocks(df, df.limit(0), "id", "v", 3).count() == 0


def test_two_branches_join_vector_and_word_candidates(spark):
    vec = lambda *x: "[" + ",".join(map(str, x)) + "]"
    rows = [("t", "both", "red copper", vec(1, 0)), ("t", "near", "tin", vec(0.9, 0.1)), ("t", "word", "copper red", None), ("t", "half", "red", vec(-1, 0)), ("t", "bad", None, "[1,null]"), ("t", "both", "red copper", vec(1, 0))]
    df = spark.createDataFrame(rows, "tenant_id string, assertion_id string, search_text string, embedding_json string")
    got = [(r["assertion_id"], r["lexical"]) for r in search.two_branches(df, ["red", "copper"], [1.0, 0.0], candidate_limit=2).collect()]
    assert got == [("both", 1.0), ("near", 0.0), ("word", 1.0)]
    assert search.two_branches(df.limit(0), ["red"], [1.0]).count() == 0


def test_graph_holds_only_edges_of_the_time(spark, tmp_path):
    from chronofold.plans import ledger

    far = datetime(2020, 1, 1, tzinfo=timezone.utc) - T0
    hours = int(far.total_seconds() // 3600)
    rows = [claim("e1", '"b"', system=hours, valid=hours, subject="a", entity="b"), claim("e2", '"c"', system=hours, valid=hours, subject="a", entity="c", valid_to=hours + 1), claim("e3", '"d"', system=48, valid=48, subject="a", entity="d")]
    frame(spark, rows).write.parquet(str(tmp_path / "assertions.parquet"))
    assert {r["node"] for r in ledger.graph_distance(spark, str(tmp_path)).collect()} == {"a", "b"}


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_percentiles_are_exact_with_blocks(spark, per_task):
    import math
    import random

    r = random.Random(1)
    rows = [("a", float(r.randint(0, 40))) for _ in range(101)] + [("b", float(i)) for i in range(6)] + [("c", None), (None, 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").selectExpr("*", "1 as g_", "2 as n_")
    got = {x["k"]: x for x in metrics.percentiles(df, ["k"], "v", {"p10": 0.1, "p95": 0.95}, per_task).collect()}
    for k in ("a", "b", None):
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert (got[k]["p10"], got[k]["p95"], got[k]["n"]) == (v[math.ceil(0.1 * len(v)) - 1], v[math.ceil(0.95 * len(v)) - 1], len(v))
        assert got[k]["median"] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert (got["c"]["n"], got["c"]["p10"], got["c"]["median"]) == (0, None, None)
    assert metrics.percentiles(df.limit(0), ["k"], "v", {"p10": 0.1}).count() == 0


def test_ends_of_groups_of_any_size(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 7), ("b", 3), ("c", 1), ("d", 4)) for i in range(n)], "k string, i int")
    got = {(r["k"], r["i"]): (r["first_rank"], r["last_rank"], r["n_in_group"]) for r in records.ends_of_group(df, ["k"], ["i"], 2).collect()}
    want = {(k, i): (i + 1, n - i, n) for k, n in (("a", 7), ("b", 3), ("c", 1), ("d", 4)) for i in range(n) if i < 2 or n - i <= 2}
    assert got == want


def test_timeline_in_blocks(spark):
    rows = [claim(f"a{i:02d}", f'"{i}"', system=(i * 7) % 23 // 2) for i in range(23)] + [claim("z", '"z"', subject="other")]
    df = frame(spark, rows)
    whole, cut = ({tuple(r) for r in temporal.timeline(df, n).collect()} for n in (1_000_000, 4))
    assert whole == cut and len(cut) == 24
