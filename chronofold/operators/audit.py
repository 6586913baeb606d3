"""Audit questions and integrity checks as semi and anti joins and one-pass counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effect_evidence(effects: DataFrame, assertions: DataFrame, history: DataFrame) -> DataFrame:
    """For every effect: whether its decision and policy exist, are current when it
    was created, rest on an artifact, and whether its workflow revision exists."""
    e = effects.select("tenant_id", "effect_id", "instance_id", F.col("originating_revision").alias("revision"), "decision_assertion_id", "policy_assertion_id", F.unix_micros("created_at").alias("t")).distinct()
    a = assertions.select("tenant_id", "assertion_id", F.unix_micros("system_from").alias("a"), F.unix_micros("system_to").alias("z"), "status", F.col("source_artifact_id").isNotNull().alias("sourced")).distinct()

    def side(name: str) -> DataFrame:
        return a.select("tenant_id", F.col("assertion_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("a", "z", "status", "sourced")))

    def exists(name: str):
        return F.col(f"{name}_a").isNotNull()

    def current(name: str):
        return F.coalesce((F.col(f"{name}_status") == "active") & (F.col(f"{name}_a") <= F.col("t")) & (F.col(f"{name}_z").isNull() | (F.col(f"{name}_z") > F.col("t"))), F.lit(False))

    h = history.select("tenant_id", "instance_id", "revision", F.lit(True).alias("h")).distinct()
    j = e.join(side("decision_assertion_id"), ["tenant_id", "decision_assertion_id"], "left").join(side("policy_assertion_id"), ["tenant_id", "policy_assertion_id"], "left").join(h, ["tenant_id", "instance_id", "revision"], "left")
    return j.select(
        "tenant_id", "effect_id", exists("decision_assertion_id").alias("has_decision"), current("decision_assertion_id").alias("decision_current"), F.coalesce("decision_assertion_id_sourced", F.lit(False)).alias("decision_sourced"),
        exists("policy_assertion_id").alias("has_policy"), current("policy_assertion_id").alias("policy_current"), F.coalesce("h", F.lit(False)).alias("has_revision"),
    )


def violations(assertions: DataFrame) -> DataFrame:
    """Counts of ill-formed assertions by rule, in one pass."""
    rules = {
        "valid interval": F.col("valid_to") <= F.col("valid_from"),
        "system interval": F.col("system_to") <= F.col("system_from"),
        "authority": ~F.col("authority").between(0, 100),
        "probability": (F.col("strength_type") == "probability") & ~F.get_json_object("strength_json", "$.value").try_cast("double").between(0, 1),
        "self supersession": F.col("supersedes_assertion_id") == F.col("assertion_id"),
        "empty reference": (F.col("source_artifact_id") == "") | (F.col("supersedes_assertion_id") == ""),
    }
    rows = assertions.dropDuplicates(["tenant_id", "assertion_id"])
    g = rows.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(f"r{i}") for i, c in enumerate(rules.values())))
    return g.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n")) for i, n in enumerate(rules)))))


def without_parent(children: DataFrame, parents: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of children without a row of parents: an anti join on the named columns."""
    keys = parents.select(*(F.col(p).alias("k_" + c) for c, p in on.items())).distinct()
    return children.join(keys, reduce(lambda a, b: a & b, (children[c] == keys["k_" + c] for c in on)), "left_anti")


def latest_time(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The largest time over several tables, to seed a monotone clock after a restart."""
    return reduce(DataFrame.unionByName, (t.agg(F.max(F.unix_micros(c)).alias("us")) for t, c in tables)).agg(F.max("us").alias("latest_us"))
