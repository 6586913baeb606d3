"""Protocol operations in batch: each request row gets a status and an error.

The requests of a batch are checked against the ledger with joins; what is
accepted is appended by the caller. Tenants are part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import make_id

# Which ends a lineage relation may join.
RELATIONS = {
    "evidence_for": [("artifact", "assertion")],
    "supports": [("assertion", "assertion")],
    "contradicts": [("assertion", "assertion")],
    "governs": [("assertion", "assertion"), ("assertion", "effect")],
    "authorizes": [("assertion", "effect")],
    "produces": [("workflow", "effect")],
    "verifies": [("effect", "assertion")],
}


def first_true(**cases: Column) -> Column:
    """The name of the first condition that is true, else null."""
    out = F.lit(None).cast("string")
    for name, c in reversed(cases.items()):
        out = F.when(F.coalesce(c, F.lit(False)), name.replace("_", " ")).otherwise(out)
    return out


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status_", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))


def put_artifacts(requests: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """tenant_id, artifact_id, outcome: the id is the given one, else made of tenant,
    source and content hash. The first content of an id is inserted, equal ones are
    replays, others conflict. Retention, sensitivity and time are not compared."""
    made = F.sha2("content", 256)
    r = requests.select("tenant_id", F.coalesce("artifact_id", make_id("artifact", "tenant_id", "source_identity", made, digits=24)).alias("artifact_id"), F.struct(made.alias("sha"), "media_type", "source_identity").alias("body"), "created_at")
    first = r.groupBy("tenant_id", "artifact_id").agg(F.min(F.struct("created_at", "body")).alias("x")).select("tenant_id", "artifact_id", F.col("x.body").alias("kept"), F.lit(False).alias("old"))
    if ledger is not None:
        old = ledger.select("tenant_id", "artifact_id", F.struct(F.col("content_hash").alias("sha"), "media_type", "source_identity").alias("kept")).dropDuplicates(["tenant_id", "artifact_id"])
        first = first.join(old.withColumnRenamed("kept", "before"), ["tenant_id", "artifact_id"], "left").select("tenant_id", "artifact_id", F.coalesce("before", "kept").alias("kept"), F.col("before").isNotNull().alias("old"))
    g = r.join(first, ["tenant_id", "artifact_id"]).groupBy("tenant_id", "artifact_id").agg(F.count(F.lit(1)).alias("n_requests"), F.sum((F.col("body") != F.col("kept")).cast("long")).alias("n_conflicts"), F.max("old").alias("old"))
    return g.select("tenant_id", "artifact_id", F.when(F.col("n_conflicts") > 0, "conflict").when(F.col("old") | (F.col("n_requests") > 1), "replayed").otherwise("inserted").alias("outcome"), "n_requests", "n_conflicts")


def check_assertions(requests: DataFrame, ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """tenant_id, assertion_id, error: the first rule a new assertion breaks.

    Valid interval, authority 0..100, strength (probability in 0..1, low <= high,
    supporting <= considered), a source artifact that exists and is not deleted,
    and a predecessor of the same claim that was open when the row was recorded."""
    cols = ["subject_entity_id", "predicate", "perspective", "valid_from", "valid_to", "system_from", "authority", "strength_type", "strength_json", "source_artifact_id", "supersedes_assertion_id"]
    r = requests.groupBy("tenant_id", "assertion_id").agg(*(F.max(c).alias(c) for c in cols))
    prior = ledger.groupBy("tenant_id", F.col("assertion_id").alias("supersedes_assertion_id")).agg(*(F.max(c).alias("p_" + c) for c in ("subject_entity_id", "predicate", "perspective", "system_from", "system_to")))
    source = artifacts.groupBy("tenant_id", F.col("artifact_id").alias("source_artifact_id")).agg(F.max((F.col("status") == "deleted").cast("int")).alias("gone"))
    j = r.join(prior, ["tenant_id", "supersedes_assertion_id"], "left").join(source, ["tenant_id", "source_artifact_id"], "left")
    num = lambda k: F.get_json_object("strength_json", f"$.{k}").try_cast("double")
    same = (F.col("p_subject_entity_id") == F.col("subject_entity_id")) & (F.col("p_predicate") == F.col("predicate")) & (F.col("p_perspective") == F.col("perspective"))
    error = first_true(
        valid_interval=F.col("valid_to") <= F.col("valid_from"),
        authority=~F.col("authority").between(0, 100),
        strength=((F.col("strength_type") == "probability") & ~num("value").between(0, 1)) | ((F.col("strength_type") == "interval") & (num("low") > num("high"))) | ((F.col("strength_type") == "evidence_count") & (num("supporting") > num("considered"))),
        source_not_found=F.col("source_artifact_id").isNotNull() & F.col("gone").isNull(),
        source_deleted=F.col("gone") == 1,
        predecessor_not_found=F.col("supersedes_assertion_id").isNotNull() & F.col("p_system_from").isNull(),
        predecessor_of_another_claim=~same,
        predecessor_not_open=(F.col("p_system_from") > F.col("system_from")) | (F.col("p_system_to") < F.col("system_from")),
    )
    return j.select("tenant_id", "assertion_id", error.alias("error"))


def check_lineage(edges: DataFrame) -> DataFrame:
    """Adds error: an unknown relation, ends of the wrong type, or an edge to itself.
    Ends are texts of type and id."""
    kind = lambda c: F.substring_index(c, ":", 1)
    pairs = F.array(*(F.lit(f"{r}/{a}/{b}") for r, ends in RELATIONS.items() for a, b in ends))
    error = first_true(unknown_relation=~F.col("relation").isin(list(RELATIONS)), self_edge=F.col("src") == F.col("dst"), wrong_ends=~F.array_contains(pairs, F.concat_ws("/", "relation", kind("src"), kind("dst"))))
    return edges.withColumn("error", error)


def new_edges(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Valid requested edges that do not exist yet, once each."""
    return check_lineage(requests).where("error is null").drop("error").dropDuplicates(["tenant_id", "edge_id"]).join(existing.select("tenant_id", "edge_id").distinct(), ["tenant_id", "edge_id"], "left_anti")


def replays(requests: DataFrame, keys: list[str], order: list[str], body: Column) -> DataFrame:
    """Each request's outcome under its idempotency key: the first runs, later ones
    with the same body are replays, others conflict. The first is found by an
    aggregate and joined back, so a key may repeat any number of times."""
    r = requests.withColumn("body_", body)
    first = r.groupBy(*keys).agg(F.min(F.struct(*order, "body_")).alias("f_"))
    j = r.join(first, keys)
    is_first = F.struct(*order, "body_") == F.col("f_")
    return j.withColumn("outcome", F.when(is_first, "executed").when(F.col("body_") == F.col("f_.body_"), "replayed").otherwise("conflict")).drop("f_", "body_")


def permitted(requests: DataFrame, keys: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Adds allowed: the caller's key exists, is not revoked or expired at the time of
    the request, and its scopes and purposes hold what the operation needs."""
    scope = F.create_map(*(F.lit(x) for kv in needed.items() for x in kv))
    k = keys.select("tenant_id", "principal_id", "scopes", "purposes", "expires_at", "revoked_at")
    j = requests.join(k, ["tenant_id", "principal_id"], "left")
    live = (F.col("revoked_at").isNull() | (F.col("revoked_at") > F.col("at"))) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("at")))
    ok = live & F.array_contains("scopes", F.get(F.map_values(F.map_filter(scope, lambda a, b: a == F.col("operation"))), F.lit(0))) & F.array_contains("purposes", F.col("purpose"))
    g = j.withColumn("ok_", F.coalesce(F.col("scopes").isNotNull() & ok, F.lit(False)))
    return g.groupBy(*requests.columns).agg(F.max("ok_").alias("allowed"))


def due_timers(timers: DataFrame, at: Column, limit: int | None = 100) -> DataFrame:
    """Pending timers due at the time, oldest first; a batch of limit, or all."""
    due = timers.where((F.col("status") == "pending") & (F.col("due_at") <= at)).orderBy("due_at", "timer_id")
    return due if limit is None else due.limit(limit)
