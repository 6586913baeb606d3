"""Queries of the general training-data problems (1, 3, 4, 5) over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, intervals, knowntime, orphans
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return knowntime.effects_with_known_assertions(table(spark, d, "effect_intents"), table(spark, d, "assertions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy.supersession(table(spark, d, "assertions")).nodes
    named = table(spark, d, "assertions").where("supersedes_assertion_id is not null").select(F.col("tenant_id").alias("group_id"), F.col("assertion_id").alias("node_id"))
    return rows.join(named, ["group_id", "node_id"], "left_semi").select(F.col("node_id").alias("assertion_id"), F.col("root_id").alias("root_assertion_id"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.supersession(table(spark, d, "assertions"), linked_only=False).paths().select(F.col("group_id").alias("tenant_id"), F.col("node_id").alias("assertion_id"), "path")


def p3_later_replacements(spark: SparkSession, d: str) -> DataFrame:
    """The later replacements of an assertion are those of its tenant and root whose
    place lies after its own, up to last_place; Hierarchy.descendants gives them as pairs."""
    rows = hierarchy.supersession(table(spark, d, "assertions"), linked_only=False).intervals()
    return rows.select(F.col("group_id").alias("tenant_id"), F.col("node_id").alias("assertion_id"), F.col("root_id").alias("root_assertion_id"), "place", "last_place")


def p3_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Subtree sizes of every assertion off cycles."""
    rows = hierarchy.supersession(table(spark, d, "assertions"), linked_only=False).nodes.where("depth >= 0")
    return rows.select(F.col("group_id").alias("tenant_id"), F.col("node_id").alias("assertion_id"), "subtree_size")


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy.supersession(table(spark, d, "assertions")).nodes.where("depth < 0")
    return rows.groupBy(F.col("group_id").alias("tenant_id"), F.col("root_id").alias("cycle_id")).agg(F.sum(F.col("on_cycle").cast("long")).alias("n_on_cycle"), F.sum((~F.col("on_cycle")).cast("long")).alias("n_leading_to_it"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.assertion_gaps(table(spark, d, "assertions"))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.assertion_periods(table(spark, d, "assertions").dropDuplicates(["tenant_id", "assertion_id"]))


def p5_all(spark: SparkSession, d: str) -> DataFrame:
    return orphans.ledger_orphans(table(spark, d, "effect_intents"), table(spark, d, "assertions"), table(spark, d, "artifacts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_all(spark, d).select("ref_field", "record_id", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(p5_all(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_paths, p3_later_replacements, p3_subtrees, p3_cycles, p4_found, p4_periods, p5_found, p5_report)}

_P5 = """
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, status, system_from, source_artifact_id FROM assertions),
     t AS (SELECT DISTINCT tenant_id, artifact_id, status, created_at FROM artifacts),
     e AS (SELECT DISTINCT tenant_id, effect_id, decision_assertion_id, policy_assertion_id, created_at FROM effect_intents),
     r AS (
       SELECT 'effect_intents.decision_assertion_id' AS ref_field, e.effect_id AS record_id, e.created_at AS ts, a.assertion_id AS target, a.status, a.system_from AS recorded
       FROM e LEFT JOIN a ON a.tenant_id = e.tenant_id AND a.assertion_id = e.decision_assertion_id WHERE e.decision_assertion_id IS NOT NULL
       UNION ALL
       SELECT 'effect_intents.policy_assertion_id', e.effect_id, e.created_at, a.assertion_id, a.status, a.system_from
       FROM e LEFT JOIN a ON a.tenant_id = e.tenant_id AND a.assertion_id = e.policy_assertion_id WHERE e.policy_assertion_id IS NOT NULL
       UNION ALL
       SELECT 'assertions.source_artifact_id', a.assertion_id, a.system_from, t.artifact_id, t.status, t.created_at
       FROM a LEFT JOIN t ON t.tenant_id = a.tenant_id AND t.artifact_id = a.source_artifact_id WHERE a.source_artifact_id IS NOT NULL),
     f AS (
       SELECT DISTINCT ref_field, record_id, year(ts AT TIME ZONE 'UTC') * 100 + month(ts AT TIME ZONE 'UTC') AS period,
              CASE WHEN target IS NULL THEN 'missing' WHEN status = 'deleted' THEN 'deleted' WHEN recorded > ts THEN 'late' END AS reason
       FROM r)
"""

_TREE = """
WITH RECURSIVE n AS (SELECT DISTINCT tenant_id, assertion_id, supersedes_assertion_id AS up FROM assertions),
     k AS (SELECT n.tenant_id, n.assertion_id, p.assertion_id AS up, n.up IS NOT NULL AS named FROM n LEFT JOIN n p ON p.tenant_id = n.tenant_id AND p.assertion_id = n.up),
     w AS (
       SELECT tenant_id, assertion_id, assertion_id AS root, CAST(0 AS BIGINT) AS depth, assertion_id AS path FROM k WHERE up IS NULL
       UNION ALL
       SELECT k.tenant_id, k.assertion_id, w.root, w.depth + 1, w.path || '/' || k.assertion_id FROM w JOIN k ON k.tenant_id = w.tenant_id AND k.up = w.assertion_id),
     stray AS (SELECT k.tenant_id, k.assertion_id, k.up FROM k WHERE k.up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.tenant_id = k.tenant_id AND w.assertion_id = k.assertion_id)),
     climb AS (
       SELECT tenant_id, assertion_id, up AS above FROM stray
       UNION
       SELECT c.tenant_id, c.assertion_id, s.up FROM climb c JOIN stray s ON s.tenant_id = c.tenant_id AND s.assertion_id = c.above),
     ring AS (SELECT DISTINCT tenant_id, assertion_id FROM climb WHERE above = assertion_id),
     low AS (SELECT c.tenant_id, c.assertion_id, min(c.above) AS root FROM climb c JOIN ring r ON r.tenant_id = c.tenant_id AND r.assertion_id = c.above GROUP BY ALL)
"""

_COVER = """
WITH v AS (
       SELECT DISTINCT tenant_id, assertion_id, subject_entity_id, predicate, epoch_us(valid_from) AS s, coalesce(epoch_us(valid_to), 9223372036854775807) AS e
       FROM assertions WHERE status NOT IN ('quarantined', 'deleted') AND (valid_to IS NULL OR valid_to > valid_from)),
     r AS (SELECT *, max(e) OVER (PARTITION BY tenant_id, subject_entity_id, predicate ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)
"""

ORACLES = {
    "p1_found": """
WITH e AS (
       SELECT DISTINCT tenant_id, effect_id, created_at,
              coalesce(json_extract_string(request_json, '$.subjectEntityId'), json_extract_string(request_json, '$.context.subjectEntityId')) AS s,
              coalesce(json_extract_string(request_json, '$.predicate'), json_extract_string(request_json, '$.context.predicate')) AS p
       FROM effect_intents)
SELECT DISTINCT e.effect_id, a.assertion_id
FROM e JOIN assertions a ON a.tenant_id = e.tenant_id AND a.subject_entity_id = e.s AND a.predicate = e.p
WHERE a.status NOT IN ('quarantined', 'deleted')
  AND a.valid_from <= e.created_at AND (a.valid_to IS NULL OR e.created_at < a.valid_to)
  AND a.system_from <= e.created_at AND (a.system_to IS NULL OR e.created_at < a.system_to)""",
    "p3_found": _TREE + """
SELECT w.assertion_id, w.root AS root_assertion_id, w.depth FROM w JOIN k ON k.tenant_id = w.tenant_id AND k.assertion_id = w.assertion_id WHERE k.named
UNION ALL SELECT assertion_id, root, CAST(-1 AS BIGINT) FROM low""",
    "p3_paths": _TREE + """
SELECT tenant_id, assertion_id, path FROM w""",
    "p3_later_replacements": _TREE + """,
     d AS (SELECT tenant_id, assertion_id, assertion_id AS below FROM w UNION ALL SELECT d.tenant_id, d.assertion_id, k.assertion_id FROM d JOIN k ON k.tenant_id = d.tenant_id AND k.up = d.below),
     z AS (SELECT tenant_id, assertion_id, count(*) AS n FROM d GROUP BY ALL),
     c AS (SELECT k.tenant_id, k.assertion_id, k.up, z.n, row_number() OVER (PARTITION BY k.tenant_id, k.up ORDER BY z.n DESC, k.assertion_id DESC) > 1 AS later
           FROM k JOIN z ON z.tenant_id = k.tenant_id AND z.assertion_id = k.assertion_id WHERE k.up IS NOT NULL),
     o AS (SELECT *, 1 + coalesce(sum(n) OVER (PARTITION BY tenant_id, up ORDER BY later, assertion_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM c),
     p AS (SELECT tenant_id, assertion_id, assertion_id AS root, CAST(0 AS BIGINT) AS place FROM k WHERE up IS NULL
           UNION ALL
           SELECT o.tenant_id, o.assertion_id, p.root, CAST(p.place + o.skip AS BIGINT) FROM p JOIN o ON o.tenant_id = p.tenant_id AND o.up = p.assertion_id)
SELECT p.tenant_id, p.assertion_id, p.root AS root_assertion_id, p.place, CAST(p.place + z.n - 1 AS BIGINT) AS last_place FROM p JOIN z ON z.tenant_id = p.tenant_id AND z.assertion_id = p.assertion_id""",
    "p3_subtrees": _TREE + """,
     d AS (SELECT tenant_id, assertion_id, assertion_id AS below FROM w UNION ALL SELECT d.tenant_id, d.assertion_id, k.assertion_id FROM d JOIN k ON k.tenant_id = d.tenant_id AND k.up = d.below)
SELECT tenant_id, assertion_id, count(*) AS subtree_size FROM d GROUP BY tenant_id, assertion_id""",
    "p3_cycles": _TREE + """
SELECT l.tenant_id, l.root AS cycle_id, count(r.assertion_id) AS n_on_cycle, count(*) - count(r.assertion_id) AS n_leading_to_it
FROM low l LEFT JOIN ring r ON r.tenant_id = l.tenant_id AND r.assertion_id = l.assertion_id GROUP BY l.tenant_id, l.root""",
    "p4_found": _COVER + "SELECT tenant_id, subject_entity_id, predicate, reach AS gap_from_us, s AS gap_to_us FROM r WHERE s > reach",
    "p4_periods": _COVER + """,
     i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, subject_entity_id, predicate ORDER BY s, e, reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS no FROM r)
SELECT tenant_id, subject_entity_id, predicate, CAST(no AS BIGINT) AS period_no, min(s) AS from_us, CASE WHEN max(e) < 9223372036854775807 THEN max(e) END AS to_us, count(*) AS n_intervals
FROM i GROUP BY tenant_id, subject_entity_id, predicate, no""",
    "p5_found": _P5 + "SELECT DISTINCT ref_field, record_id, reason FROM f WHERE reason IS NOT NULL",
    "p5_report": _P5 + "SELECT ref_field, CAST(period AS INTEGER) AS period, reason, count(*) AS n_records FROM f WHERE reason IS NOT NULL GROUP BY ref_field, period, reason",
}
