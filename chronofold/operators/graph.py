"""Bounded traversal of entity and lineage graphs.

Distances go level by level: the frontier is joined to the edges, rows already
reached are left out, and each level is written before the next. The capped trace
of one record is small by its caps, so its levels are fetched with pushed-down
filters and limits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

# Limits of traversals.
MAX_DEPTH = 8
TRACE_NODES = 500
TRACE_EDGES = 2000


def entity_edges(assertions: DataFrame) -> DataFrame:
    """Both directions of every entity-valued assertion: tenant_id, src, dst."""
    e = assertions.where("object_entity_id is not null").select("tenant_id", F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"))
    return e.union(e.select("tenant_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def distances(edges: DataFrame, starts: DataFrame, max_depth: int = 2) -> DataFrame:
    """tenant_id, start, node, distance: shortest hops from each start (tenant_id,
    start), up to max_depth (clamped to 0..8). An unknown start reaches only itself."""
    tmp = Scratch(edges.sparkSession, "graph")
    reached = level = tmp.save(starts.select("tenant_id", "start", F.col("start").alias("node"), F.lit(0).alias("distance")).distinct())
    if max_depth > 0:
        edges = tmp.save(edges)
    for d in range(1, max(0, min(MAX_DEPTH, max_depth)) + 1):
        step = level.join(edges.select("tenant_id", F.col("src").alias("node"), "dst"), ["tenant_id", "node"]).select("tenant_id", "start", F.col("dst").alias("node")).distinct()
        level = tmp.save(step.join(reached.select("tenant_id", "start", "node"), ["tenant_id", "start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if not level.limit(1).count():
            break
        reached = reached.unionByName(level)
    return reached


def lineage(assertions: DataFrame, effects: DataFrame) -> DataFrame:
    """Typed edges between the records: edge_id, tenant_id, relation, src, dst, at_us.
    Endpoints are texts of type and id."""
    from ..functions.scalars import make_id

    named = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c))
    a = assertions.select("tenant_id", "assertion_id", "source_artifact_id", "system_from").distinct()
    e = effects.select("tenant_id", "effect_id", "instance_id", "originating_revision", "decision_assertion_id", "policy_assertion_id", "created_at").distinct()
    parts = [
        a.where("source_artifact_id <> ''").select("tenant_id", F.lit("evidence_for").alias("relation"), named("artifact", "source_artifact_id").alias("src"), named("assertion", "assertion_id").alias("dst"), F.unix_micros("system_from").alias("at_us")),
        e.where("decision_assertion_id <> ''").select("tenant_id", F.lit("authorizes"), named("assertion", "decision_assertion_id"), named("effect", "effect_id"), F.unix_micros("created_at")),
        e.where("policy_assertion_id <> ''").select("tenant_id", F.lit("governs"), named("assertion", "policy_assertion_id"), named("effect", "effect_id"), F.unix_micros("created_at")),
        e.select("tenant_id", F.lit("produces"), F.concat(F.lit("workflow:"), F.col("instance_id"), F.lit("@"), F.col("originating_revision").cast("string")), named("effect", "effect_id"), F.unix_micros("created_at")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.where("src <> dst").withColumn("edge_id", make_id("edge", "tenant_id", "relation", "src", "dst"))


def trace(spark: SparkSession, edges: DataFrame, tenant: str, target: str, max_depth: int = 4, max_nodes: int = TRACE_NODES, max_edges: int = TRACE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, depth; edges: edge_id, relation, src, dst) around one record,
    both directions, level by level, in order of time and id. An edge whose new
    ends would pass the node cap is left out; later edges among known nodes stay."""
    mine = edges.where(F.col("tenant_id") == tenant)
    depth_of = {target: 0}
    kept: dict[str, tuple[str, str, str]] = {}
    frontier, kept_here = [target], None
    for depth in range(1, max(0, min(MAX_DEPTH, max_depth)) + 1):
        if not frontier or len(kept) >= max_edges:
            break
        if kept_here is None:  # the tenant's edges are read once, not once a level
            kept_here = Scratch(spark, "trace").save(mine)
        near = kept_here.where(F.col("src").isin(frontier) | F.col("dst").isin(frontier))
        fresh: list[str] = []
        for r in near.orderBy("at_us", "edge_id").limit(max_edges + 1 + len(kept)).collect():
            if r["edge_id"] in kept:
                continue
            new = [x for x in (r["src"], r["dst"]) if x not in depth_of]
            if len(depth_of) + len(new) > max_nodes:
                continue
            if len(kept) >= max_edges:
                break
            kept[r["edge_id"]] = (r["relation"], r["src"], r["dst"])
            for x in new:
                depth_of[x] = depth
                fresh.append(x)
        frontier = fresh
    nodes = spark.createDataFrame(sorted((d, n) for n, d in depth_of.items()), "depth int, node string").select("node", "depth")
    return nodes, spark.createDataFrame([(k, *v) for k, v in sorted(kept.items())], "edge_id string, relation string, src string, dst string")


def render(nodes: Iterable[tuple[str, int]]) -> str:
    """Indented text of a trace; control characters are escaped."""
    safe = lambda s: "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in s)
    return "\n".join("  " * d + safe(n) for n, d in nodes)
