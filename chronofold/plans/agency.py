"""Queries of workflows, effects, budgets, permissions and traces, with their SQL twins.

The tables hold no keys, attempts, commands or leases; where an operator needs them they
are derived here by plain rules, alike in the query and in its twin."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agency, graph, intake, knowntime, records
from ..operators.common import us
from ..sources.tables import table
from .ledger import _EDGES, _T, AT, _lineage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH h AS (SELECT DISTINCT tenant_id, instance_id, event_id, revision, prior_state AS p, new_state AS n FROM machine_history),
     c AS (SELECT * FROM h WHERE revision % 8 <> 5 UNION ALL SELECT tenant_id, instance_id, 'stale-' || event_id, revision, 'stale', n FROM h WHERE revision % 3 = 0),
     g AS (SELECT tenant_id, instance_id, list(struct_pack(r := revision, e := event_id, p := p, n := n) ORDER BY revision, event_id) AS rows FROM c GROUP BY ALL),
     f AS (SELECT tenant_id, instance_id, list_reduce(rows, lambda a, x: CASE WHEN x.r = a.r + 1 AND (x.r = 1 OR x.p = a.s) THEN {'r': x.r, 's': x.n, 'ok': list_append(a.ok, x.e)} ELSE a END, {'r': 0, 's': '', 'ok': CAST([] AS VARCHAR[])}) AS z FROM g)
SELECT c.tenant_id, c.instance_id, c.revision, c.event_id, list_contains(f.z.ok, c.event_id) AS accepted FROM c JOIN f ON f.tenant_id = c.tenant_id AND f.instance_id = c.instance_id""")
def workflow_commands(spark, d):
    """The history as commands, of which every eighth revision got lost and every third
    has a rival from a stale state."""
    h = table(spark, d, "machine_history").select("tenant_id", "instance_id", "event_id", "revision", "prior_state", "new_state")
    stale = h.where("revision % 3 = 0").withColumns({"event_id": F.concat(F.lit("stale-"), "event_id"), "prior_state": F.lit("stale")})
    return agency.transitions(h.where("revision % 8 <> 5").unionByName(stale), ["revision", "event_id"])


_OUTCOME = "CASE WHEN event_id % 7 = 3 THEN 'failed' WHEN event_id % 7 = 5 THEN 'succeeded' ELSE 'unknown' END"


@query(f"""
WITH e AS (SELECT user_id, event_type, list({_OUTCOME} ORDER BY ts, event_id) AS rows FROM events GROUP BY ALL),
     f AS (SELECT user_id, event_type, list_reduce(rows, lambda a, x: CASE WHEN a.s IN ('succeeded', 'failed') THEN a ELSE
             {{'s': CASE WHEN x <> 'unknown' THEN x WHEN a.s = 'reconciling' OR a.n >= 3 OR a.n + 1 >= 3 THEN 'reconciling' ELSE 'unknown' END,
               'n': a.n + CASE WHEN a.s = 'reconciling' OR a.n >= 3 THEN 0 ELSE 1 END, 'm': a.m + CASE WHEN a.s = 'reconciling' OR a.n >= 3 THEN 1 ELSE 0 END}} END, {{'s': 'planned', 'n': 0, 'm': 0}}) AS z FROM e)
SELECT user_id, event_type, z.s AS status, z.n AS attempt_count, z.m AS reconciliation_count, CAST(CASE WHEN z.s IN ('succeeded', 'failed') THEN 0 ELSE least(3600, 30 * pow(2, least(z.m, 6))) END AS INTEGER) AS delay_s FROM f""")
def effect_heads(spark, d):
    """Events as deliveries of one effect per user and type, with at most three attempts."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.expr(_OUTCOME).alias("outcome"))
    steps = agency.attempts(e, ["user_id", "event_type"], ["ts", "event_id"], "outcome", 3)
    return agency.heads(steps, ["user_id", "event_type"], ["ts", "event_id"], ["status", "attempt_count", "reconciliation_count", "delay_s"])


@query("""
WITH e AS (SELECT tenant_id, effect_id, min(currency) AS currency, CAST(max(budget_amount) * 10000 AS BIGINT) AS amount, max(status) AS status, epoch_us(min(created_at)) AS a, epoch_us(max(updated_at)) AS z
           FROM effect_intents WHERE budget_amount IS NOT NULL AND currency IS NOT NULL GROUP BY ALL),
     x AS (SELECT tenant_id, currency, a AS t, FALSE AS settles, effect_id, amount, status FROM e UNION ALL SELECT tenant_id, currency, greatest(a, z), TRUE, effect_id, amount, status FROM e WHERE status IN ('succeeded', 'failed', 'cancelled')),
     g AS (SELECT tenant_id, currency, list(struct_pack(t := t, settles := settles, id := effect_id, amount := amount, status := status) ORDER BY t, settles, effect_id) AS rows FROM x GROUP BY ALL),
     f AS (SELECT tenant_id, currency, list_reduce(rows, lambda a, x: CASE
             WHEN x.settles AND list_contains(a.ok, x.id) THEN {'r': a.r - x.amount, 's': a.s + CASE WHEN x.status = 'succeeded' THEN x.amount ELSE 0 END, 'ok': a.ok}
             WHEN NOT x.settles AND a.s + a.r + x.amount <= 5000000000 THEN {'r': a.r + x.amount, 's': a.s, 'ok': list_append(a.ok, x.id)} ELSE a END,
             {'r': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'ok': CAST([] AS VARCHAR[])}) AS z, len(list_filter(rows, lambda x: NOT x.settles)) AS n FROM g)
SELECT tenant_id, currency, z.r AS reserved, z.s AS spent, len(z.ok) AS n_admitted, n - len(z.ok) AS n_denied FROM f""")
def budget_fold(spark, d):
    steps = agency.budget_steps(table(spark, d, "effect_intents"), 5_000_000_000)
    last = agency.heads(steps, ["tenant_id", "currency"], ["at_us", "settles", "effect_id"], ["reserved", "spent"])
    n = steps.groupBy("tenant_id", "currency").agg(F.count_if("admitted").alias("n_admitted"), F.count_if(~F.col("admitted")).alias("n_denied"))
    return last.join(n, ["tenant_id", "currency"])


_STATE = "CASE WHEN status = 'unknown' AND attempt_count >= 2 THEN 'reconciling' WHEN status = 'planned' AND attempt_count % 2 = 1 THEN 'dispatching' WHEN status = 'planned' AND length(purpose) % 2 = 0 THEN 'dispatching' ELSE status END"


@query(f"""
WITH e AS (SELECT DISTINCT tenant_id, effect_id, created_at, attempt_count, {_STATE} AS status, epoch_us(updated_at) + least(3600, 30 * CAST(pow(2, least(attempt_count, 6)) AS INTEGER)) * 1000000 AS next_us, epoch_us(updated_at) + 30000000 AS lease_us FROM effect_intents)
SELECT tenant_id, effect_id, status IN ('reconciling', 'dispatching') OR attempt_count >= 10 AS reconcile FROM e
WHERE next_us <= epoch_us({_T}) AND (status IN ('planned', 'unknown', 'reconciling') OR status = 'dispatching' AND lease_us < epoch_us({_T}))
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, effect_id) = 1""")
def effect_leases(spark, d):
    """The next effect of each tenant, with leases that ran out taken over."""
    later = lambda s: F.timestamp_micros(us("updated_at") + s * 1_000_000)
    e = table(spark, d, "effect_intents").select("tenant_id", "effect_id", "created_at", "attempt_count", F.expr(_STATE).alias("status"), later(S.retry_seconds("attempt_count")).alias("next_attempt_at"), later(F.lit(agency.LEASE_SECONDS)).alias("lease_expires_at"))
    return agency.leasable(e, F.lit(AT).cast("timestamp"))


_KEYS = f"""
WITH t AS (SELECT DISTINCT tenant_id, length(tenant_id) % 5 <> 0 AS active FROM entities),
     k AS (SELECT DISTINCT tenant_id, purpose AS key_id, CASE WHEN length(tenant_id) % 4 = 0 THEN ['facts:read'] ELSE ['facts:read', 'effects:write'] END AS scopes, CASE WHEN length(purpose) % 3 = 0 THEN ['*'] ELSE [purpose] END AS purposes,
             CASE WHEN length(purpose) % 2 = 0 THEN TIMESTAMPTZ '2024-06-01 00:00:00+00' END AS expires_at, CASE WHEN length(tenant_id || purpose) % 7 = 0 THEN TIMESTAMPTZ '2024-03-01 00:00:00+00' END AS revoked_at FROM effect_intents)
"""


def _keys(spark, d) -> tuple[DataFrame, DataFrame]:
    """A key for each purpose of a tenant, some expired, revoked or without the scope."""
    tenants = table(spark, d, "entities").select("tenant_id", (F.length("tenant_id") % 5 != 0).alias("active")).distinct()
    text = lambda *x: F.array(*(F.lit(s) for s in x))
    when = lambda c, t: F.when(c, F.lit(t).cast("timestamp"))
    k = table(spark, d, "effect_intents").select("tenant_id", "purpose").distinct()
    return k.select(
        "tenant_id", F.col("purpose").alias("key_id"), F.col("purpose").alias("principal_id"), F.when(F.length("tenant_id") % 4 == 0, text("facts:read")).otherwise(text("facts:read", "effects:write")).alias("scopes"), F.when(F.length("purpose") % 3 == 0, text("*")).otherwise(F.array("purpose")).alias("purposes"),
        when(F.length("purpose") % 2 == 0, "2024-06-01 00:00:00").alias("expires_at"), when(F.length(F.concat("tenant_id", "purpose")) % 7 == 0, "2024-03-01 00:00:00").alias("revoked_at"),
    ), tenants


@query(_KEYS + f"""
SELECT DISTINCT e.tenant_id, e.effect_id, CASE WHEN e.attempt_count > 0 OR coalesce(k.revoked_at IS NULL AND (k.expires_at IS NULL OR k.expires_at > {_T}) AND list_contains(k.scopes, 'effects:write') AND t.active AND (list_contains(k.purposes, '*') OR list_contains(k.purposes, e.purpose)), FALSE) THEN 'kept' ELSE 'cancelled' END AS outcome
FROM effect_intents e LEFT JOIN k ON k.tenant_id = e.tenant_id AND k.key_id = e.purpose LEFT JOIN t ON t.tenant_id = e.tenant_id WHERE e.status NOT IN ('succeeded', 'failed', 'cancelled')""")
def effect_authorisation(spark, d):
    """Unfinished effects kept or cancelled by the keys and tenants behind them."""
    keys, tenants = _keys(spark, d)
    e = table(spark, d, "effect_intents").select("tenant_id", "effect_id", "status", "purpose", F.col("purpose").alias("key_id"), F.when(F.col("attempt_count") > 0, F.col("created_at")).alias("authorized_at"))
    return agency.authorised(e, keys, tenants, F.lit(AT).cast("timestamp"))


@query(_KEYS + """
SELECT DISTINCT e.tenant_id, e.effect_id, coalesce((k.revoked_at IS NULL OR k.revoked_at > e.created_at) AND (k.expires_at IS NULL OR k.expires_at > e.created_at) AND list_contains(k.scopes, 'effects:write') AND list_contains(k.purposes, e.purpose), FALSE) AS allowed
FROM effect_intents e LEFT JOIN k ON k.tenant_id = e.tenant_id AND k.key_id = e.purpose""")
def permitted_requests(spark, d):
    keys, _ = _keys(spark, d)
    r = table(spark, d, "effect_intents").select("tenant_id", "effect_id", F.col("purpose").alias("principal_id"), "purpose", F.lit("request_effect").alias("operation"), F.col("created_at").alias("at")).distinct()
    return intake.permitted(r, keys, {"request_effect": "effects:write"}).select("tenant_id", "effect_id", "allowed")


_MANIFESTS = """
WITH m AS (
  SELECT DISTINCT tenant_id, 'assert' AS op, assertion_id AS id, CASE WHEN source_artifact_id IS NULL THEN '{"artifactIds":[],"assertionIds":["' || assertion_id || '"]}' ELSE '{"artifactIds":["' || source_artifact_id || '"],"assertionIds":["' || assertion_id || '"]}' END AS evidence FROM assertions
  UNION ALL SELECT DISTINCT tenant_id, 'request_effect', effect_id, '{"effectIds":["' || effect_id || '"],"machineIds":["' || instance_id || '"]}' FROM effect_intents
  UNION ALL SELECT DISTINCT tenant_id, 'get_machine', instance_id, '{"machineIds":["' || instance_id || '"]}' FROM machine_instances
  UNION ALL SELECT DISTINCT tenant_id, 'put_entity', entity_id, '{}' FROM entities)
"""


@query(_MANIFESTS + """
SELECT tenant_id, op, id, evidence, sha256(concat(id, chr(0))) AS result_hash,
       'receipt_' || substr(sha256(concat(tenant_id, chr(0), 'agent', chr(0), 'audit', chr(0), id, chr(0), op, chr(0), sha256(concat(id, chr(0))), chr(0), evidence, chr(0))), 1, 32) AS receipt_id FROM m""")
def receipts_with_evidence(spark, d):
    none = F.lit(None).cast("string")
    of = lambda t, op, i, **more: table(spark, d, t).select("tenant_id", F.lit(op).alias("op"), F.col(i).alias("id"), *(more.get(x, none).alias(x) for x in ("assertion", "artifact", "effect", "machine")))
    rows = [
        of("assertions", "assert", "assertion_id", assertion=F.col("assertion_id"), artifact=F.col("source_artifact_id")), of("effect_intents", "request_effect", "effect_id", effect=F.col("effect_id"), machine=F.col("instance_id")),
        of("machine_instances", "get_machine", "instance_id", machine=F.col("instance_id")), of("entities", "put_entity", "entity_id"),
    ]
    c = F.col
    made = reduce(DataFrame.unionByName, rows).distinct().withColumn("evidence", agency.manifest(c("op"), assertions=c("assertion"), artifacts=c("artifact"), effects=c("effect"), machines=c("machine")))
    receipt, hashed = agency.receipt(c("tenant_id"), F.lit("agent"), F.lit("audit"), c("id"), c("op"), c("id"), c("evidence"))
    return made.select("tenant_id", "op", "id", "evidence", hashed.alias("result_hash"), receipt.alias("receipt_id"))


@query("""
WITH t AS (SELECT 'tn' AS tenant_id, event_type AS p, CAST(user_id AS VARCHAR) AS run, CAST(event_id AS VARCHAR) AS turn FROM events)
SELECT tenant_id, 'agent-turn:' || substr(sha256(concat('["' || tenant_id || '","' || p || '","' || run || '","' || turn || '"]', chr(0))), 1, 32) AS artifact_id,
       '{"principal":{"principalId":"' || p || '","tenantId":"' || tenant_id || '"},"run":{"runId":"' || run || '"},"schemaVersion":1,"turn":{"turnId":"' || turn || '"}}' AS content, 'agent:' || p AS source_identity, CAST(NULL AS VARCHAR) AS error FROM t""")
def turn_records(spark, d):
    e = table(spark, d, "events").select(F.lit("tn").alias("tenant_id"), F.col("event_type").alias("principal_id"), F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("turn_id"))
    return agency.turn_records(e.withColumn("body", F.concat(F.lit('{"turnId":"'), "turn_id", F.lit('"}'))))


_LABELS = _EDGES + """,
     n AS (SELECT tenant_id, src AS node FROM l UNION SELECT tenant_id, dst FROM l),
     lab AS (
       SELECT tenant_id, 'artifact:' || artifact_id AS node, min('Artifact from ' || source_identity) AS label FROM artifacts GROUP BY ALL
       UNION ALL SELECT tenant_id, 'assertion:' || assertion_id, min(kind || ' ' || predicate || ' = ' || concat_ws(' ', coalesce(json_extract_string(object_json, '$.value'), json_extract_string(object_json, '$.entityId')), json_extract_string(object_json, '$.unit'))) FROM assertions GROUP BY ALL
       UNION ALL SELECT h.tenant_id, 'workflow:' || h.instance_id || '@' || h.revision, min(i.machine_type || ' ' || transition_name || ': ' || prior_state || ' -> ' || new_state) FROM machine_history h JOIN machine_instances i ON i.tenant_id = h.tenant_id AND i.instance_id = h.instance_id GROUP BY ALL
       UNION ALL SELECT tenant_id, 'effect:' || effect_id, min(effect_type || ' effect ' || status) FROM effect_intents GROUP BY ALL)
SELECT n.tenant_id, n.node, lab.label FROM n LEFT JOIN lab ON lab.tenant_id = n.tenant_id AND lab.node = n.node"""


def _nodes(spark, d) -> DataFrame:
    e = _lineage(spark, d)
    return e.select("tenant_id", F.col("src").alias("node")).union(e.select("tenant_id", "dst")).distinct()


def _hydrated(spark, d, nodes: DataFrame) -> DataFrame:
    return agency.hydrated(nodes, *(table(spark, d, t) for t in ("assertions", "artifacts", "machine_history", "machine_instances", "effect_intents")))


@query(_LABELS)
def lineage_node_labels(spark, d):
    return _hydrated(spark, d, _nodes(spark, d)).select("tenant_id", "node", "label")


@query("""
WITH n AS (SELECT tenant_id, effect_id, min(to_json(struct_pack(attemptCount := attempt_count, effectId := effect_id, effectType := effect_type, outcome := outcome_json, purpose := purpose, request := request_json, status := status, target := target))) AS r FROM effect_intents GROUP BY ALL)
SELECT tenant_id, 'effect:' || effect_id AS node, CASE WHEN length(r) <= 4000 THEN r ELSE to_json(struct_pack(truncated := TRUE, characters := length(r), preview := substr(r, 1, 4000))) END AS record FROM n""")
def lineage_effect_records(spark, d):
    nodes = table(spark, d, "effect_intents").select("tenant_id", F.concat(F.lit("effect:"), "effect_id").alias("node"))
    return _hydrated(spark, d, nodes).where("node like 'effect:%'").select("tenant_id", "node", "record")


@query(_EDGES + """,
     k AS (SELECT DISTINCT tenant_id, 'assertion:' || assertion_id AS node FROM assertions UNION SELECT tenant_id, 'artifact:' || artifact_id FROM artifacts UNION SELECT tenant_id, 'workflow:' || instance_id || '@' || revision FROM machine_history UNION SELECT tenant_id, 'effect:' || effect_id FROM effect_intents),
     b AS (SELECT DISTINCT tenant_id, 'assertion:' || assertion_id AS node, kind, status, epoch_us(valid_from) AS va, epoch_us(valid_to) AS vz, epoch_us(system_from) AS sa, epoch_us(system_to) AS sz FROM assertions)
SELECT l.tenant_id, l.edge_id, CASE WHEN s.node IS NULL THEN 'source not found' WHEN t.node IS NULL THEN 'target not found'
  WHEN l.relation IN ('governs', 'authorizes') AND NOT coalesce(b.kind = CASE l.relation WHEN 'governs' THEN 'directive' ELSE 'decision' END AND b.status = 'active' AND b.va <= l.at_us AND (b.vz IS NULL OR b.vz > l.at_us) AND b.sa <= l.at_us AND (b.sz IS NULL OR b.sz > l.at_us), FALSE) THEN 'not current' END AS error
FROM l LEFT JOIN k s ON s.tenant_id = l.tenant_id AND s.node = l.src LEFT JOIN k t ON t.tenant_id = l.tenant_id AND t.node = l.dst LEFT JOIN b ON b.tenant_id = l.tenant_id AND b.node = l.src""")
def lineage_faults(spark, d):
    ids = lambda t, *parts: table(spark, d, t).select("tenant_id", F.concat(*parts).alias("node"))
    known = [ids("assertions", F.lit("assertion:"), "assertion_id"), ids("artifacts", F.lit("artifact:"), "artifact_id"), ids("machine_history", F.lit("workflow:"), "instance_id", F.lit("@"), F.col("revision").cast("string")), ids("effect_intents", F.lit("effect:"), "effect_id")]
    return agency.lineage_faults(_lineage(spark, d), reduce(DataFrame.union, known), table(spark, d, "assertions")).select("tenant_id", "edge_id", "error")


@query(_EDGES + "SELECT relation, count(*) AS n FROM (SELECT DISTINCT tenant_id, edge_id, relation FROM l) WHERE edge_id > 'edge_8' GROUP BY relation")
def lineage_new_edges(spark, d):
    """Every edge is asked for twice, and about half of them exist already."""
    e = _lineage(spark, d)
    return intake.new_edges(e.unionByName(e), e.where("edge_id <= 'edge_8'")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = """
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, subject_entity_id AS s, predicate AS p, object_key AS o, kind, status, authority, strength_json AS sj, source_artifact_id AS src, supersedes_assertion_id AS up, epoch_us(system_from) AS a, epoch_us(system_to) AS z FROM assertions),
     e AS (SELECT DISTINCT tenant_id, effect_id, instance_id, decision_assertion_id AS di, policy_assertion_id AS pi, status, attempt_count, outcome_json IS NOT NULL AS outcome, idempotency_key AS ik, lower(regexp_extract(target, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin, epoch_us(created_at) AS t, epoch_us(updated_at) AS u,
             coalesce(json_extract_string(request_json, '$.subjectEntityId'), json_extract_string(request_json, '$.context.subjectEntityId')) AS s, coalesce(json_extract_string(request_json, '$.predicate'), json_extract_string(request_json, '$.context.predicate')) AS p FROM effect_intents),
     seen AS (SELECT a.tenant_id, a.s, min(a.a) AS x FROM a JOIN (SELECT DISTINCT tenant_id, artifact_id FROM artifacts) r ON r.tenant_id = a.tenant_id AND r.artifact_id = a.src WHERE kind = 'observation' GROUP BY ALL),
     aft AS (SELECT tenant_id, s, max(a) AS x FROM a WHERE kind = 'observation' GROUP BY ALL),
     hyp AS (SELECT tenant_id, s, p, o, min(a) AS a FROM a WHERE kind = 'hypothesis' GROUP BY ALL),
     riv AS (SELECT tenant_id, s, p, a AS x FROM hyp QUALIFY row_number() OVER (PARTITION BY tenant_id, s, p ORDER BY a, o) = 2),
     rev AS (SELECT DISTINCT a.tenant_id, a.s FROM a JOIN a q ON q.tenant_id = a.tenant_id AND q.assertion_id = a.up WHERE a.kind = 'hypothesis' AND (q.authority <> a.authority OR q.sj <> a.sj)),
     use AS (SELECT tenant_id, origin, ik, count(*) AS n FROM e GROUP BY ALL),
     ins AS (SELECT tenant_id, instance_id, max(terminal) AS terminal FROM machine_instances GROUP BY ALL)
SELECT e.tenant_id, e.effect_id, coalesce(seen.x <= e.t, FALSE) AS observed, coalesce(riv.x <= e.t, FALSE) AS competing, rev.s IS NOT NULL AS revised, coalesce(d.kind = 'decision' AND y.kind = 'directive', FALSE) AS selected,
       coalesce(d.status = 'active' AND d.a <= e.t AND (d.z IS NULL OR d.z > e.t) AND y.status = 'active' AND y.a <= e.t AND (y.z IS NULL OR y.z > e.t), FALSE) AS authorised, coalesce(e.origin <> '' AND use.n = 1, FALSE) AS addressed,
       coalesce(e.status = 'unknown' OR e.attempt_count > 1, FALSE) AS ambiguous, e.status IN ('succeeded', 'failed') AND e.outcome AS settled,
       coalesce(aft.x > e.u AND ins.terminal AND EXISTS (SELECT 1 FROM machine_history h WHERE h.tenant_id = e.tenant_id AND h.instance_id = e.instance_id), FALSE) AS verified
FROM e LEFT JOIN seen ON seen.tenant_id = e.tenant_id AND seen.s = e.s LEFT JOIN aft ON aft.tenant_id = e.tenant_id AND aft.s = e.s LEFT JOIN riv ON riv.tenant_id = e.tenant_id AND riv.s = e.s AND riv.p = e.p LEFT JOIN rev ON rev.tenant_id = e.tenant_id AND rev.s = e.s
     LEFT JOIN a d ON d.tenant_id = e.tenant_id AND d.assertion_id = e.di LEFT JOIN a y ON y.tenant_id = e.tenant_id AND y.assertion_id = e.pi LEFT JOIN use ON use.tenant_id = e.tenant_id AND use.origin = e.origin AND use.ik = e.ik LEFT JOIN ins ON ins.tenant_id = e.tenant_id AND ins.instance_id = e.instance_id"""


@query(_ANSWERS)
def audit_answers(spark, d):
    s, p = knowntime.named_in_request()
    return agency.answers(*(table(spark, d, t) for t in ("effect_intents", "assertions", "artifacts", "machine_history", "machine_instances")), s, p)


@query("""
SELECT DISTINCT effect_id, json_extract_string(request_json, '$.amount') AS amount, coalesce(regexp_full_match(json_extract_string(request_json, '$.amount'), '(0|[1-9][0-9]{0,15})(\\.[0-9]{1,4})?'), FALSE) AS is_money,
       strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(created_at) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at_utc,
       CASE WHEN length(request_json) <= 100 THEN request_json ELSE to_json(struct_pack(truncated := TRUE, characters := length(request_json), preview := substr(request_json, 1, 100))) END AS request FROM effect_intents""")
def request_forms(spark, d):
    """Amounts, times with an offset and long requests in their checked forms."""
    amount = F.get_json_object("request_json", "$.amount")
    offset = F.concat(F.date_format(F.col("created_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, d, "effect_intents").select("effect_id", amount.alias("amount"), F.coalesce(S.is_money(amount), F.lit(False)).alias("is_money"), S.iso_utc(offset).alias("at_utc"), S.truncated("request_json", 100).alias("request")).distinct()


@query("""
WITH h AS (SELECT tenant_id, instance_id, arg_max(new_state, revision) AS s FROM machine_history GROUP BY ALL)
SELECT DISTINCT i.tenant_id, i.instance_id, i.instance_id LIKE 'order:%' AND i.machine_type <> 'retail_order' AS reserved_name, (CASE WHEN i.revision % 4 = 0 THEN NULL ELSE i.state END) IS DISTINCT FROM h.s AS state_differs
FROM machine_instances i LEFT JOIN h ON h.tenant_id = i.tenant_id AND h.instance_id = i.instance_id""")
def instance_rules(spark, d):
    """Names reserved to one type, and states that differ from the history's; the state of
    every fourth revision is taken for unknown."""
    i = table(spark, d, "machine_instances").select("tenant_id", "instance_id", "machine_type", "revision", F.when(F.col("revision") % 4 != 0, F.col("state")).alias("state")).distinct()
    h = records.head(table(spark, d, "machine_history")).select("tenant_id", "instance_id", F.col("state").alias("s_"))
    reserved = F.col("instance_id").startswith("order:") & (F.col("machine_type") != "retail_order")
    return i.join(h, ["tenant_id", "instance_id"], "left").select("tenant_id", "instance_id", reserved.alias("reserved_name"), (~F.col("state").eqNullSafe(F.col("s_"))).alias("state_differs"))


@query("""
SELECT coalesce(CASE WHEN NOT regexp_matches(j, '[A-Za-z]') THEN json_array_length(TRY_CAST(j AS JSON)) END, -1) AS dims, count(*) AS n FROM (SELECT tenant_id, assertion_id, min(embedding_json) AS j FROM assertions WHERE status NOT IN ('quarantined', 'deleted') GROUP BY ALL) GROUP BY 1""")
def embedding_spaces(spark, d):
    """How many assertions have vectors of each length; -1 without one."""
    from ..operators.common import visible

    rows = table(spark, d, "assertions").where(visible()).groupBy("tenant_id", "assertion_id").agg(F.min("embedding_json").alias("j"))
    return rows.groupBy(F.coalesce(F.when(~F.col("j").rlike("[A-Za-z]"), F.json_array_length("j")), F.lit(-1)).alias("dims")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT tenant_id, status, CAST(sum(CASE WHEN attempt_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_delivered, CAST(sum(greatest(attempt_count - 1, 0)) AS BIGINT) AS n_repeats, sum(CASE WHEN copies = 2 THEN 1 ELSE 0 END) > 0 AS delivered_twice
FROM (SELECT tenant_id, effect_id, max(status) AS status, max(attempt_count) AS attempt_count, count(*) AS copies FROM effect_intents GROUP BY ALL) GROUP BY ALL""")
def delivery_counters(spark, d):
    e = table(spark, d, "effect_intents").groupBy("tenant_id", "effect_id").agg(F.max("status").alias("status"), F.max("attempt_count").alias("attempt_count"), F.count(F.lit(1)).alias("copies"))
    n = lambda c: F.sum(c.cast("long"))
    return e.groupBy("tenant_id", "status").agg(n(F.col("attempt_count") > 0).alias("n_delivered"), n(F.greatest(F.col("attempt_count") - 1, F.lit(0))).alias("n_repeats"), (n(F.col("copies") == 2) > 0).alias("delivered_twice"))


@query("SELECT DISTINCT tenant_id, instance_id, revision, 'event_' || substr(sha256(concat(tenant_id, chr(0), instance_id, chr(0), revision, chr(0), transition_name, chr(0))), 1, 32) AS event_id FROM machine_history")
def history_event_ids(spark, d):
    return table(spark, d, "machine_history").select("tenant_id", "instance_id", "revision", S.make_id("event", "tenant_id", "instance_id", "revision", "transition_name").alias("event_id")).distinct()


@query(f"""
WITH f AS (SELECT DISTINCT 'store/' || content_hash AS path, content_hash AS name, CASE WHEN content_hash >= 'f' THEN sha256(content) ELSE content_hash END AS sha, epoch_us(created_at) AS us FROM artifacts)
SELECT path, 'unreferenced' AS fault FROM f WHERE us < epoch_us({_T}) AND sha NOT IN (SELECT content_hash FROM artifacts WHERE status <> 'deleted')
UNION ALL SELECT path, 'damaged' FROM f WHERE regexp_full_match(name, '[0-9a-f]{{64}}') AND name <> sha""")
def artifact_reconciliation(spark, d):
    """Stored bodies that no kept artifact refers to, or whose bytes are not what their name
    says; bodies from f on are taken for damaged."""
    from ..sources.files import damaged_files, unreferenced_files

    a = table(spark, d, "artifacts")
    sha = F.when(F.col("content_hash") >= "f", F.sha2("content", 256)).otherwise(F.col("content_hash"))
    files = a.select(F.concat(F.lit("store/"), "content_hash").alias("path"), F.col("content_hash").alias("name"), sha.alias("sha"), us("created_at").alias("modified_us")).distinct()
    at = round(datetime.fromisoformat(AT + "+00:00").timestamp() * 1e6)
    lost = unreferenced_files(files, a.where("status <> 'deleted'"), at).select("path", F.lit("unreferenced").alias("fault"))
    return lost.unionByName(damaged_files(files).select("path", F.lit("damaged").alias("fault")))
