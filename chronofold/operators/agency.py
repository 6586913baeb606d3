"""Workflows, effects, budgets, permissions, receipts and records of agent turns.

What a service keeps in mutable rows is folded here from commands and attempts: a
fold streams each key in order with a small state (see folds.fold); everything else
is joins and column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .common import us
from .folds import fold

# Deliveries before an effect is only reconciled, and seconds of a lease.
MAX_ATTEMPTS = 10
LEASE_SECONDS = 30
TERMINAL = ("succeeded", "failed", "cancelled")


def transitions(commands: DataFrame, order: list[str]) -> DataFrame:
    """tenant_id, instance_id, order, accepted: a command asks for a revision from a
    prior state. It is accepted if it is the next revision of its instance and starts
    from its state; a rejected one changes nothing. The first has revision 1. Rows with
    a null key are left out; a null revision is rejected."""

    def step(head: tuple, row: tuple) -> tuple[tuple, tuple]:
        revision, prior, new = row
        ok = revision is not None and revision == head[0] + 1 and (revision == 1 or prior == head[1])
        return (revision, new) if ok else head, (ok,)

    rows = commands.dropna(subset=["tenant_id", "instance_id"]).select("tenant_id", "instance_id", *dict.fromkeys([*order, "revision", "prior_state", "new_state"])).distinct()
    return fold(rows, ["tenant_id", "instance_id"], order, lambda r: (0, None), step, ["revision", "prior_state", "new_state"], "accepted boolean")


def attempts(deliveries: DataFrame, keys: list[str], order: list[str], outcome: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """keys, order, attempt_number, status, attempt_count, reconciliation_count, delay_s
    after each delivery: an unknown outcome is tried again, after max_attempts deliveries
    only reconciled; a delivery after the end is ignored (its number is null)."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        status, tried, reconciled = state
        if status in TERMINAL:
            return state, (None, status, tried, reconciled, 0)
        again = status == "reconciling" or tried >= max_attempts
        number = tried + reconciled + 1
        tried, reconciled = tried + (not again), reconciled + again
        if row[0] in ("succeeded", "failed"):
            status = row[0]
        else:
            status = "reconciling" if again or tried >= max_attempts else "unknown"
        delay = 0 if status in TERMINAL else min(3600, 30 * 2 ** min(reconciled, 6))
        return (status, tried, reconciled), (number, status, tried, reconciled, delay)

    return fold(deliveries, keys, order, lambda r: ("planned", 0, 0), step, [outcome], "attempt_number int, status string, attempt_count int, reconciliation_count int, delay_s int")


def heads(steps: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The last row of each key by order."""
    return steps.groupBy(*keys).agg(F.max(F.struct(*order, *cols)).alias("x_")).select(*keys, *(F.col(f"x_.{c}").alias(c) for c in cols))


def budget_steps(effects: DataFrame, limit: int) -> DataFrame:
    """tenant_id, currency, at_us, settles, effect_id, admitted, reserved, spent after each
    reservation and settlement, in ten-thousandths. An amount is reserved at created_at if
    it fits with what is reserved and spent; at updated_at a finished effect gives it back,
    and a succeeded one spends it. A denied effect settles nothing."""
    e = effects.where("budget_amount is not null and currency is not null").groupBy("tenant_id", "effect_id").agg(F.min("currency").alias("currency"), F.max((F.col("budget_amount") * 10_000).cast("long")).alias("amount"), F.max("status").alias("status"), F.min(us("created_at")).alias("a_"), F.max(us("updated_at")).alias("z_"))
    asked = e.select("tenant_id", "currency", F.col("a_").alias("at_us"), F.lit(False).alias("settles"), "effect_id", "amount", "status")
    ended = e.where(F.col("status").isin(*TERMINAL)).select("tenant_id", "currency", F.greatest("a_", "z_").alias("at_us"), F.lit(True).alias("settles"), "effect_id", "amount", "status")

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        reserved, spent, held = state
        settles, effect, amount, status = row
        ok = None
        if settles:
            if effect in held:
                reserved = max(0, reserved - held.pop(effect))
                spent += amount if status == "succeeded" else 0
        else:
            ok = spent + reserved + amount <= limit
            if ok:
                reserved += amount
                held[effect] = amount
        return (reserved, spent, held), (ok, reserved, spent)

    return fold(asked.unionByName(ended), ["tenant_id", "currency"], ["at_us", "settles", "effect_id"], lambda r: (0, 0, {}), step, ["settles", "effect_id", "amount", "status"], "admitted boolean, reserved bigint, spent bigint")


def leasable(effects: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """tenant_id, effect_id, reconcile: the oldest effect of each tenant that may be leased:
    due, and not leased by another worker or so long ago that the lease ran out; a lease
    taken over and an effect out of attempts is reconciled, not delivered."""
    open_ = F.col("status").isin("planned", "unknown", "reconciling") | ((F.col("status") == "dispatching") & (F.col("lease_expires_at") < now))
    due = effects.where(open_ & (F.col("next_attempt_at") <= now))
    reconcile = F.col("status").isin("reconciling", "dispatching") | (F.col("attempt_count") >= max_attempts)
    return due.groupBy("tenant_id").agg(F.min(F.struct("created_at", "effect_id", reconcile.alias("reconcile"))).alias("x")).select("tenant_id", F.col("x.effect_id").alias("effect_id"), F.col("x.reconcile").alias("reconcile"))


def authorised(effects: DataFrame, keys: DataFrame, tenants: DataFrame, now: Column, scope: str = "effects:write") -> DataFrame:
    """tenant_id, effect_id, outcome of unfinished effects: kept, cancelled if the key that
    asked for it (tenant_id, key_id, scopes, purposes, expires_at, revoked_at) no longer
    allows it or its tenant is not active, and kept if it was authorised before."""
    e = effects.where(~F.col("status").isin(*TERMINAL)).select("tenant_id", "effect_id", "key_id", "purpose", "authorized_at").distinct()
    k = keys.join(tenants.select("tenant_id", "active"), "tenant_id").withColumn("live_", (F.col("revoked_at").isNull()) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.array_contains("scopes", scope) & F.col("active"))
    j = e.join(k.select("tenant_id", "key_id", "live_", "purposes"), ["tenant_id", "key_id"], "left")
    fit = F.coalesce(F.col("live_") & (F.array_contains("purposes", "*") | F.array_contains("purposes", F.col("purpose"))), F.lit(False))
    return j.groupBy("tenant_id", "effect_id").agg(F.when(F.max(F.col("authorized_at").isNotNull() | fit), "kept").otherwise("cancelled").alias("outcome"))


def manifest(op: Column, *, assertions: Column | None = None, artifacts: Column | None = None, effects: Column | None = None, machines: Column | None = None, edges: Column | None = None) -> Column:
    """What a result rests on, by the operation's kind of result, as canonical JSON."""
    ids = lambda c: F.array_compact(F.array(c))
    made = lambda **parts: F.to_json(F.struct(*(ids(c).alias(n) for n, c in sorted(parts.items()))))
    out = F.lit("{}")
    if edges is not None:
        out = F.when(op == "add_lineage", made(lineageEdgeIds=edges)).otherwise(out)
    if machines is not None:
        out = F.when(op.isin("create_workflow", "advance_workflow", "get_machine"), made(machineIds=machines)).otherwise(out)
        if effects is not None:
            out = F.when(op.isin("request_effect", "record_effect_outcome"), made(effectIds=effects, machineIds=machines)).otherwise(out)
    if assertions is not None:
        out = F.when(op == "assert", made(assertionIds=assertions, artifactIds=artifacts if artifacts is not None else F.lit(None).cast("string"))).otherwise(out)
    return out


def receipt(tenant: Column, principal: Column, purpose: Column, request: Column, op: Column, result: Column, evidence: Column) -> tuple[Column, Column]:
    """(receipt id, hash of the result), over everything that was executed."""
    hashed = S.sha_parts(result)
    return S.make_id("receipt", tenant, principal, purpose, request, op, hashed, evidence), hashed


def turn_records(turns: DataFrame, most: int = 1_000_000) -> DataFrame:
    """artifact_id, content, source_identity of each turn (tenant_id, principal_id, run_id,
    turn_id, body as canonical JSON), once; error where the content is longer than most."""
    text = lambda c: F.to_json(F.array(c))
    name = F.to_json(F.array("tenant_id", "principal_id", "run_id", "turn_id"))
    quoted = lambda c: F.regexp_extract(text(F.col(c)), r"^\[(.*)\]$", 1)
    content = F.concat(F.lit('{"principal":{"principalId":'), quoted("principal_id"), F.lit(',"tenantId":'), quoted("tenant_id"), F.lit('},"run":{"runId":'), quoted("run_id"), F.lit('},"schemaVersion":1,"turn":'), "body", F.lit("}"))
    rows = turns.select("tenant_id", F.concat(F.lit("agent-turn:"), F.substring(S.sha_parts(name), 1, 32)).alias("artifact_id"), content.alias("content"), F.concat(F.lit("agent:"), "principal_id").alias("source_identity")).distinct()
    return rows.withColumn("error", F.when(F.length("content") > most, "too long"))


def hydrated(nodes: DataFrame, assertions: DataFrame, artifacts: DataFrame, history: DataFrame, instances: DataFrame, effects: DataFrame) -> DataFrame:
    """tenant_id, node, label, record: what a trace shows of each node (tenant_id, node as
    type:id). Bodies of artifacts are left out, long records cut (see scalars.truncated).
    A node without a record keeps nulls."""
    json = lambda *c: F.to_json(F.struct(*(F.col(x).alias(y) for x, y in c)), {"ignoreNullFields": "false"})
    kind, ident = F.substring_index("node", ":", 1), F.expr("substring(node, instr(node, ':') + 1)")
    n = nodes.select("tenant_id", "node").distinct().withColumns({"kind_": kind, "id_": ident})

    def of(name: str, df: DataFrame, node: Column, label: Column, record: Column) -> DataFrame:
        made = df.select("tenant_id", node.alias("id_"), label.alias("label"), record.alias("record")).groupBy("tenant_id", "id_").agg(F.min("label").alias("label"), F.min("record").alias("record"))
        return n.where(F.col("kind_") == name).join(made, ["tenant_id", "id_"], "left").select("tenant_id", "node", "label", "record")

    state = instances.select("tenant_id", "instance_id", "machine_type").distinct()
    machine = history.join(state, ["tenant_id", "instance_id"])
    space = lambda *parts: F.concat_ws(" ", *parts)
    parts = [
        of("artifact", artifacts, F.col("artifact_id"), F.concat(F.lit("Artifact from "), "source_identity"), json(("artifact_id", "artifactId"), ("content_hash", "contentHash"), ("media_type", "mediaType"), ("source_identity", "sourceIdentity"), ("sensitivity", "sensitivity"), ("retention_policy", "retentionPolicy"), ("status", "status"))),
        of("assertion", assertions, F.col("assertion_id"), F.concat(space("kind", "predicate"), F.lit(" = "), S.typed_text("object_json")), S.truncated(json(("assertion_id", "assertionId"), ("authority", "authority"), ("kind", "kind"), ("object_key", "object"), ("perspective", "perspective"), ("predicate", "predicate"), ("status", "status"), ("subject_entity_id", "subjectEntityId")), 8_000)),
        of("workflow", machine, F.concat("instance_id", F.lit("@"), F.col("revision").cast("string")), F.concat(space("machine_type", "transition_name"), F.lit(": "), "prior_state", F.lit(" -> "), "new_state"), S.truncated(json(("data_json", "data"), ("event_id", "eventId"), ("instance_id", "instanceId"), ("new_state", "newState"), ("prior_state", "priorState"), ("revision", "revision"), ("transition_name", "transitionName"), ("machine_type", "workflowType")), 8_000)),
        of("effect", effects, F.col("effect_id"), F.concat("effect_type", F.lit(" effect "), "status"), S.truncated(json(("attempt_count", "attemptCount"), ("effect_id", "effectId"), ("effect_type", "effectType"), ("outcome_json", "outcome"), ("purpose", "purpose"), ("request_json", "request"), ("status", "status"), ("target", "target")), 4_000)),
    ]
    return reduce(DataFrame.unionByName, parts)


def answers(effects: DataFrame, assertions: DataFrame, artifacts: DataFrame, history: DataFrame, instances: DataFrame, subject: Column, predicate: Column) -> DataFrame:
    """tenant_id, effect_id and nine booleans that an audit asks of every effect about the
    entity and attribute it names:

    observed: an observation about the entity, recorded before, with an existing source;
    competing: before it, hypotheses about the attribute with more than one object;
    revised: a hypothesis about the entity replaced one of another authority or strength;
    selected: its decision and its policy are of these kinds; authorised: both were active
    and recorded then; addressed: its target has an origin and its key is used once there;
    ambiguous: it is unknown or was tried more than once; settled: it ended with an outcome;
    verified: an observation about the entity came after, and its workflow has ended."""
    e = effects.select("tenant_id", "effect_id", "instance_id", "decision_assertion_id", "policy_assertion_id", "status", "attempt_count", F.col("outcome_json").isNotNull().alias("outcome"), "idempotency_key", S.url_origin("target").alias("origin"), us("created_at").alias("t"), us("updated_at").alias("u"), subject.alias("s"), predicate.alias("p")).dropDuplicates(["tenant_id", "effect_id"])
    a = assertions.groupBy("tenant_id", "assertion_id").agg(*(F.max(c).alias(c) for c in ("subject_entity_id", "predicate", "object_key", "kind", "status", "authority", "strength_json", "source_artifact_id", "supersedes_assertion_id")), F.max(us("system_from")).alias("a"), F.max(us("system_to")).alias("z"))
    there = artifacts.select("tenant_id", F.col("artifact_id").alias("source_artifact_id")).distinct()
    of = lambda df: df.select("tenant_id", F.col("subject_entity_id").alias("s"), "a")
    seen = of(a.where("kind = 'observation'").join(there, ["tenant_id", "source_artifact_id"], "left_semi")).groupBy("tenant_id", "s").agg(F.min("a").alias("first_seen"))
    after = of(a.where("kind = 'observation'")).groupBy("tenant_id", "s").agg(F.max("a").alias("last_seen"))
    first = a.where("kind = 'hypothesis'").groupBy("tenant_id", F.col("subject_entity_id").alias("s"), F.col("predicate").alias("p"), "object_key").agg(F.min("a").alias("a"))
    second = Window.partitionBy("tenant_id", "s", "p").orderBy("a", "object_key")
    rival = first.withColumn("no_", F.row_number().over(second)).where("no_ = 2").select("tenant_id", "s", "p", F.col("a").alias("rivals_from"))
    prior = a.select("tenant_id", F.col("assertion_id").alias("supersedes_assertion_id"), F.col("authority").alias("pa"), F.col("strength_json").alias("ps"))
    revised = a.where("kind = 'hypothesis'").join(prior, ["tenant_id", "supersedes_assertion_id"]).where("pa <> authority or ps <> strength_json").select("tenant_id", F.col("subject_entity_id").alias("s"), F.lit(True).alias("revised")).distinct()
    side = lambda c, x: a.select("tenant_id", F.col("assertion_id").alias(c), F.col("kind").alias(x + "_kind"), ((F.col("status") == "active")).alias(x + "_active"), F.col("a").alias(x + "_a"), F.col("z").alias(x + "_z"))
    used = e.groupBy("tenant_id", "origin", "idempotency_key").agg(F.count(F.lit(1)).alias("uses"))
    ended = instances.groupBy("tenant_id", "instance_id").agg(F.max("terminal").alias("terminal"))
    top = history.groupBy("tenant_id", "instance_id").agg(F.max("revision").alias("head"))
    j = e.join(side("decision_assertion_id", "d"), ["tenant_id", "decision_assertion_id"], "left").join(side("policy_assertion_id", "y"), ["tenant_id", "policy_assertion_id"], "left")
    j = j.join(seen, ["tenant_id", "s"], "left").join(after, ["tenant_id", "s"], "left").join(revised, ["tenant_id", "s"], "left").join(rival, ["tenant_id", "s", "p"], "left")
    j = j.join(used, ["tenant_id", "origin", "idempotency_key"], "left").join(ended, ["tenant_id", "instance_id"], "left").join(top, ["tenant_id", "instance_id"], "left")
    held = lambda x: F.col(x + "_active") & (F.col(x + "_a") <= F.col("t")) & (F.col(x + "_z").isNull() | (F.col(x + "_z") > F.col("t")))
    yes = {
        "observed": F.col("first_seen") <= F.col("t"), "competing": F.col("rivals_from") <= F.col("t"), "revised": F.col("revised"), "selected": (F.col("d_kind") == "decision") & (F.col("y_kind") == "directive"), "authorised": held("d") & held("y"),
        "addressed": F.col("origin").isNotNull() & (F.col("uses") == 1), "ambiguous": (F.col("status") == "unknown") | (F.col("attempt_count") > 1), "settled": F.col("status").isin("succeeded", "failed") & F.col("outcome"), "verified": (F.col("last_seen") > F.col("u")) & F.col("terminal") & (F.col("head") > 0),
    }
    return j.select("tenant_id", "effect_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in yes.items()))


def lineage_faults(edges: DataFrame, nodes: DataFrame, assertions: DataFrame) -> DataFrame:
    """edges with error: ends of the wrong type (see intake.check_lineage), an end that does
    not exist, or an assertion end that is not, at the edge's at_us, the active directive,
    decision or observation that its relation needs."""
    from .intake import check_lineage, first_true

    known = nodes.select("tenant_id", "node").distinct()
    a = assertions.groupBy("tenant_id", F.concat(F.lit("assertion:"), "assertion_id").alias("need_")).agg(F.max("kind").alias("k_"), F.max("status").alias("st_"), *(F.max(us(c)).alias(c[:8] + c[-4:]) for c in ("valid_from", "valid_to", "system_from", "system_to")))
    a = a.toDF("tenant_id", "need_", "k_", "st_", "va_", "vz_", "sa_", "sz_")
    wanted = F.when(F.col("relation") == "governs", "directive").when(F.col("relation") == "authorizes", "decision").when(F.col("relation") == "verifies", "observation")
    j = check_lineage(edges).withColumn("need_", F.when(F.col("relation") == "verifies", F.col("dst")).otherwise(F.col("src"))).withColumn("wanted_", wanted)
    j = j.join(known.select("tenant_id", F.col("node").alias("src"), F.lit(True).alias("s_")), ["tenant_id", "src"], "left").join(known.select("tenant_id", F.col("node").alias("dst"), F.lit(True).alias("d_")), ["tenant_id", "dst"], "left")
    j = j.join(a, ["tenant_id", "need_"], "left")
    t = F.col("at_us")
    current = (F.col("k_") == F.col("wanted_")) & (F.col("st_") == "active") & (F.col("va_") <= t) & (F.col("vz_").isNull() | (F.col("vz_") > t)) & (F.col("sa_") <= t) & (F.col("sz_").isNull() | (F.col("sz_") > t))
    error = F.coalesce("error", first_true(source_not_found=F.col("s_").isNull(), target_not_found=F.col("d_").isNull(), not_current=F.col("wanted_").isNotNull() & ~F.coalesce(current, F.lit(False))))
    return j.withColumn("error", error).select(*edges.columns, "error")
