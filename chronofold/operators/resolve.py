"""Conflict-preserving resolution of claims.

A claim's candidates either agree on one object (known), disagree (conflicted, or
resolved_with_conflict under a policy), or do not exist (unknown). One aggregate
with map-side combination does it; candidates are never collected per claim, and
conflicting ones come out as rows of a join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM = ["tenant_id", "subject_entity_id", "predicate"]
POLICIES = ("none", "latest", "highest_authority")


def resolve(candidates: DataFrame, policy: str = "none", by: list[str] = CLAIM) -> DataFrame:
    """by, status, selected_assertion_id, selected_object, n_candidates, n_objects.

    A known claim selects its latest candidate whatever the policy. Equal times
    fall to the larger assertion_id. Repeated rows count once."""
    if policy not in POLICIES:
        raise ValueError(policy)
    latest = F.max(F.struct("system_from", "assertion_id", "object_key"))
    strongest = F.max(F.struct("authority", "system_from", "assertion_id", "object_key"))
    g = candidates.dropDuplicates(["tenant_id", "assertion_id"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("object_key").alias("n_objects"), latest.alias("latest"), strongest.alias("strongest"))
    known = F.col("n_objects") <= 1
    status = F.when(known, "known").otherwise("conflicted" if policy == "none" else "resolved_with_conflict")
    pick = {"none": F.lit(None), "latest": F.col("latest.assertion_id"), "highest_authority": F.col("strongest.assertion_id")}[policy]
    value = {"none": F.lit(None), "latest": F.col("latest.object_key"), "highest_authority": F.col("strongest.object_key")}[policy]
    return g.select(*by, status.alias("status"), F.when(known, F.col("latest.assertion_id")).otherwise(pick).alias("selected_assertion_id"), F.when(known, F.col("latest.object_key")).otherwise(value).alias("selected_object"), "n_candidates", "n_objects")


def resolve_claims(claims: DataFrame, candidates: DataFrame, policy: str = "none") -> DataFrame:
    """Resolution of the named claims; those without candidates are unknown."""
    got = claims.select(*CLAIM).distinct().join(resolve(candidates, policy), CLAIM, "left")
    return got.select(*CLAIM, F.coalesce("status", F.lit("unknown")).alias("status"), "selected_assertion_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def conflicts(candidates: DataFrame, policy: str = "none") -> DataFrame:
    """The candidates in conflict: all of them without a policy, else those whose
    object is not the selected one."""
    r = resolve(candidates, policy).where("n_objects > 1").select(*CLAIM, "selected_object")
    rows = candidates.dropDuplicates(["tenant_id", "assertion_id"]).select(*CLAIM, "assertion_id", "object_key", "authority").join(r, CLAIM)
    return rows.where(F.col("selected_object").isNull() | (F.col("object_key") != F.col("selected_object"))).drop("selected_object")
