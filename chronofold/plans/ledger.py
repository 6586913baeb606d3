"""Queries of the ledger operators over a data folder, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, context, folds, graph, intake, metrics, records, resolve, search, temporal
from ..operators.common import us, visible
from ..sources.tables import table
from .sqlguard import read_sql

AT = "2026-01-01 00:00:00"
QUERY = "storage zone ledger"
#: The tenant whose pages and best claims are shown, and the one served last.
TENANT, SERVED = "tn_brine", "tn_ember"
#: The subject with the most entity-valued assertions, the smallest of equals.
START = "subject_entity_id = (SELECT subject_entity_id FROM vis WHERE object_entity_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _assertions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assertions")


def _current(spark: SparkSession, d: str) -> DataFrame:
    return temporal.as_of(_assertions(spark, d), AT)


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return search.with_sources(_current(spark, d), table(spark, d, "artifacts"))


_T = f"TIMESTAMPTZ '{AT}+00'"
_NOW = f"""
WITH now AS (
  SELECT DISTINCT tenant_id, assertion_id, subject_entity_id, predicate, perspective, kind, object_key, object_json, object_entity_id, authority, system_from, source_artifact_id
  FROM assertions WHERE status NOT IN ('quarantined', 'deleted')
    AND valid_from <= {_T} AND (valid_to IS NULL OR valid_to > {_T}) AND system_from <= {_T} AND (system_to IS NULL OR system_to > {_T}))
"""
_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query(_NOW + "SELECT DISTINCT tenant_id, assertion_id FROM now")
def assert_as_of(spark, d):
    return _current(spark, d).select("tenant_id", "assertion_id").distinct()


@query(_NOW + "SELECT assertion_id, authority, epoch_us(system_from) AS system_from_us FROM (SELECT DISTINCT assertion_id, authority, system_from FROM now WHERE tenant_id = 'tn_brine' AND perspective = 'organization') ORDER BY authority DESC, system_from DESC, assertion_id LIMIT 50")
def assert_filtered_topk(spark, d, tenant: str = TENANT):
    rows = temporal.as_of(_assertions(spark, d), AT, tenant_id=tenant, perspective="organization").select("assertion_id", "authority", "system_from").distinct()
    return temporal.top_by_authority(rows, 50).select("assertion_id", "authority", us("system_from").alias("system_from_us"))


@query("""
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, subject_entity_id, predicate, perspective, system_from FROM assertions)
SELECT tenant_id, assertion_id, CAST(row_number() OVER w AS INTEGER) AS version_no, epoch_us(system_from) AS from_us, lead(epoch_us(system_from)) OVER w AS next_us
FROM a WINDOW w AS (PARTITION BY tenant_id, subject_entity_id, predicate, perspective ORDER BY system_from, assertion_id)""")
def assert_timeline(spark, d):
    return temporal.timeline(_assertions(spark, d))


@query("SELECT status, count(DISTINCT (tenant_id, assertion_id)) AS n, CAST(max(CASE WHEN status NOT IN ('quarantined', 'deleted') THEN 1 ELSE 0 END) AS INTEGER) AS visible FROM assertions GROUP BY status")
def visible_status_counts(spark, d):
    return temporal.status_counts(_assertions(spark, d))


@query("""
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, system_from, system_to, supersedes_assertion_id FROM assertions),
     s AS (SELECT tenant_id, supersedes_assertion_id AS assertion_id, min(system_from) AS t FROM a WHERE supersedes_assertion_id IS NOT NULL GROUP BY ALL)
SELECT a.tenant_id, a.assertion_id, epoch_us(coalesce(a.system_to, s.t)) AS system_to_us FROM a LEFT JOIN s ON s.tenant_id = a.tenant_id AND s.assertion_id = a.assertion_id""")
def supersede_derive_system_to(spark, d):
    return temporal.derived_system_to(_assertions(spark, d))


@query("""
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, subject_entity_id, predicate, perspective, system_from, supersedes_assertion_id AS up FROM assertions),
     r AS (SELECT a.tenant_id, a.assertion_id,
             CASE WHEN p.assertion_id IS NULL THEN 'absent' WHEN a.up = a.assertion_id THEN 'self'
                  WHEN p.subject_entity_id <> a.subject_entity_id OR p.predicate <> a.predicate OR p.perspective <> a.perspective THEN 'other claim'
                  WHEN p.system_from > a.system_from THEN 'later' END AS reason
           FROM a LEFT JOIN a p ON p.tenant_id = a.tenant_id AND p.assertion_id = a.up WHERE a.up IS NOT NULL)
SELECT * FROM r WHERE reason IS NOT NULL""")
def supersede_violations(spark, d):
    return temporal.supersession_faults(_assertions(spark, d))


def _resolve_sql(policy: str, by: str = "tenant_id, subject_entity_id, predicate") -> str:
    pick = {"none": ("NULL", "NULL"), "latest": ("l.assertion_id", "l.object_key"), "highest_authority": ("h.assertion_id", "h.object_key")}[policy]
    on = lambda x: " AND ".join(f"{x}.{c} = g.{c}" for c in by.split(", "))
    return _NOW + f""",
     n AS (SELECT DISTINCT tenant_id, assertion_id, subject_entity_id, predicate, perspective, object_key, authority, system_from FROM now),
     g AS (SELECT {by}, count(*) AS n_candidates, count(DISTINCT object_key) AS n_objects FROM n GROUP BY {by}),
     l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY system_from DESC, assertion_id DESC) = 1),
     h AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY authority DESC, system_from DESC, assertion_id DESC) = 1)
SELECT {", ".join("g." + c for c in by.split(", "))}, CASE WHEN n_objects <= 1 THEN 'known' ELSE '{"conflicted" if policy == "none" else "resolved_with_conflict"}' END AS status,
       CASE WHEN n_objects <= 1 THEN l.assertion_id ELSE {pick[0]} END AS selected_assertion_id, CASE WHEN n_objects <= 1 THEN l.object_key ELSE {pick[1]} END AS selected_object, n_candidates, n_objects
FROM g JOIN l ON {on("l")} JOIN h ON {on("h")}"""


@query(_resolve_sql("none"))
def resolve_none(spark, d):
    return resolve.resolve(_current(spark, d), "none")


@query(_resolve_sql("latest"))
def resolve_latest(spark, d):
    return resolve.resolve(_current(spark, d), "latest")


@query(_resolve_sql("highest_authority"))
def resolve_highest_authority(spark, d):
    return resolve.resolve(_current(spark, d), "highest_authority")


@query(_resolve_sql("highest_authority", "tenant_id, subject_entity_id, predicate, perspective"))
def resolve_by_perspective(spark, d):
    return resolve.resolve(_current(spark, d), "highest_authority", [*resolve.CLAIM, "perspective"])


@query(_NOW + """,
     g AS (SELECT tenant_id, subject_entity_id, predicate, count(DISTINCT assertion_id) AS n, count(DISTINCT object_key) AS k FROM now GROUP BY ALL),
     l AS (SELECT tenant_id, subject_entity_id, predicate, max(struct_pack(a := system_from, b := assertion_id)).b AS id FROM now GROUP BY ALL),
     c AS (SELECT DISTINCT tenant_id, subject_entity_id, predicate FROM assertions)
SELECT c.tenant_id, c.subject_entity_id, c.predicate, CASE WHEN g.n IS NULL THEN 'unknown' WHEN g.k <= 1 THEN 'known' ELSE 'conflicted' END AS status, CASE WHEN g.k <= 1 THEN l.id END AS selected_assertion_id, coalesce(g.n, 0) AS n_candidates
FROM c LEFT JOIN g ON g.tenant_id = c.tenant_id AND g.subject_entity_id = c.subject_entity_id AND g.predicate = c.predicate
       LEFT JOIN l ON l.tenant_id = c.tenant_id AND l.subject_entity_id = c.subject_entity_id AND l.predicate = c.predicate""")
def resolve_all_claims(spark, d):
    return resolve.resolve_claims(_assertions(spark, d), _current(spark, d))


@query(_NOW + """,
     g AS (SELECT tenant_id, subject_entity_id, predicate FROM now GROUP BY ALL HAVING count(DISTINCT object_key) > 1)
SELECT DISTINCT n.tenant_id, n.subject_entity_id, n.predicate, n.assertion_id, n.object_key, n.authority
FROM now n JOIN g ON g.tenant_id = n.tenant_id AND g.subject_entity_id = n.subject_entity_id AND g.predicate = n.predicate""")
def resolve_conflicts_explode(spark, d):
    return resolve.conflicts(_current(spark, d))


@query("""
SELECT tenant_id, entity_id, x.entity_type AS entity_type, x.canonical_name AS canonical_name, created_us
FROM (SELECT tenant_id, entity_id, max(struct_pack(a := created_at, canonical_name := canonical_name, entity_type := entity_type)) AS x, epoch_us(min(created_at)) AS created_us FROM entities GROUP BY tenant_id, entity_id)""")
def entity_upsert_latest(spark, d):
    return records.entity_heads(table(spark, d, "entities"))


@query("SELECT tenant_id, artifact_id, min(content_hash) AS content_hash, count(*) AS n_copies FROM artifacts GROUP BY tenant_id, artifact_id")
def artifact_dedup(spark, d):
    return records.artifact_heads(table(spark, d, "artifacts"))


#: The artifacts, and for some a second delivery of another type or source.
_DELIVERIES = """
WITH deliveries AS (SELECT tenant_id, artifact_id, content, content_hash, media_type, source_identity, created_at FROM artifacts
  UNION ALL SELECT tenant_id, artifact_id, content, content_hash, CASE WHEN content_hash < '2' THEN 'other/type' ELSE media_type END, CASE WHEN content_hash >= 'e' THEN 'other source' ELSE source_identity END, created_at + INTERVAL 1 DAY FROM artifacts WHERE content_hash < '3' OR content_hash >= 'e')
"""


def _deliveries(spark, d):
    a = table(spark, d, "artifacts").select("tenant_id", "artifact_id", "content", "content_hash", "media_type", "source_identity", F.col("created_at").cast("timestamp").alias("created_at"))
    again = a.where("content_hash < '3' or content_hash >= 'e'").withColumns({"media_type": F.when(F.col("content_hash") < "2", "other/type").otherwise(F.col("media_type")), "source_identity": F.when(F.col("content_hash") >= "e", "other source").otherwise(F.col("source_identity")), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    return a.unionByName(again)


@query(_DELIVERIES + """
SELECT tenant_id, artifact_id, count(DISTINCT content_hash) AS n_content_hash, count(DISTINCT media_type) AS n_media_type, count(DISTINCT source_identity) AS n_source_identity
FROM deliveries GROUP BY tenant_id, artifact_id HAVING n_content_hash > 1 OR n_media_type > 1 OR n_source_identity > 1""")
def artifact_conflicts(spark, d):
    return records.artifact_conflicts(_deliveries(spark, d))


@query("SELECT tenant_id, content_hash, count(DISTINCT artifact_id) AS n_ids, min(artifact_id) AS first_id FROM artifacts GROUP BY tenant_id, content_hash HAVING n_ids > 1")
def artifact_shared_content(spark, d):
    return records.shared_content(table(spark, d, "artifacts"))


@query("SELECT DISTINCT tenant_id, artifact_id, 'artifact_' || substr(sha256(concat(tenant_id, chr(0), source_identity, chr(0), sha256(content), chr(0))), 1, 24) AS derived_id, sha256(content) AS sha FROM artifacts")
def deterministic_ids(spark, d):
    return records.content_ids(table(spark, d, "artifacts"))


@query("SELECT DISTINCT tenant_id, assertion_id, object_key AS canonical FROM assertions")
def canonical_object_key(spark, d):
    return _assertions(spark, d).select("tenant_id", "assertion_id", S.canonical_json("object_json").alias("canonical")).distinct()


_TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 1)"
_TEXT = "concat_ws(' ', subject_entity_id, replace(predicate, '_', ' '), concat_ws(' ', coalesce(json_extract_string(object_json, '$.value'), json_extract_string(object_json, '$.entityId')), json_extract_string(object_json, '$.unit')), replace(kind, '_', ' '), perspective, source_text)"


def _hash_sql(tokens: str) -> str:
    e = f"list_transform(list_distinct({tokens}), lambda t: {{'slot': CAST('0x' || substr(sha256(t), 1, 4) AS INTEGER) % 64, 'w': (CASE WHEN CAST('0x' || substr(sha256(t), 5, 2) AS INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END) * (1 + ln(CAST(len(list_filter({tokens}, lambda u: u = t)) AS DOUBLE)))}})"
    return f"list_transform(range(0, 64), lambda s: CAST(coalesce(list_sum(list_transform(list_filter({e}, lambda e: e.slot = s), lambda e: e.w)), 0) AS DOUBLE))"


_QT = "['storage', 'zone', 'ledger']"
_SCORES = _NOW + f""",
     src AS (SELECT tenant_id, artifact_id AS source_artifact_id, min(concat_ws(' ', source_identity, substr(content, 1, 4096))) AS source_text FROM artifacts GROUP BY ALL HAVING bool_and(status = 'active')),
     u AS (SELECT tenant_id, assertion_id, any_value(subject_entity_id) AS subject_entity_id, any_value(object_entity_id) AS object_entity_id, any_value({_TOKENS.format(_TEXT)}) AS k FROM now LEFT JOIN src USING (tenant_id, source_artifact_id) GROUP BY tenant_id, assertion_id),
     q AS (SELECT {_hash_sql(_QT)} AS qv),
     v AS (SELECT u.*, {_hash_sql('k')} AS dv, qv FROM u, q),
     s AS (SELECT *, CASE WHEN len(list_intersect({_QT}, k)) > 0 THEN greatest(len(list_intersect({_QT}, k)) / 3.0, 0.25) ELSE 0.0 END AS lexical,
             CASE WHEN list_inner_product(dv, dv) > 0 THEN greatest(0.0, list_inner_product(dv, qv) / sqrt(list_inner_product(dv, dv)) / sqrt(list_inner_product(qv, qv))) ELSE 0.0 END AS vector FROM v)
"""


@query(_SCORES + f"SELECT tenant_id, assertion_id, {_R6.format('lexical')} AS lexical FROM s WHERE lexical > 0")
def search_lexical(spark, d):
    rows = _searched(spark, d).dropDuplicates(temporal.KEY)
    return search.scores(rows, search.text_of(rows), QUERY).where("lexical > 0").select("tenant_id", "assertion_id", S.round6(F.col("lexical")).alias("lexical"))


@query(_SCORES + f"SELECT tenant_id, assertion_id, {_R6.format('vector')} AS vector FROM s")
def search_feature_hash(spark, d):
    rows = _searched(spark, d).dropDuplicates(temporal.KEY)
    return search.scores(rows, search.text_of(rows), QUERY).select("tenant_id", "assertion_id", S.round6(F.col("vector")).alias("vector"))


@query(f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     p AS (SELECT q.vec_id AS query_id, v.vec_id, {_R6.format("list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e)))")} AS cosine FROM v q, v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, cosine FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 20""")
def search_vector_topk(spark, d):
    """The 20 nearest of every vector whose id is divisible by 20, against all vectors."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nearest_in_blocks(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 20).withColumnRenamed("vec_id_query", "query_id")


_EMBEDDED = _NOW.replace("source_artifact_id\n", "source_artifact_id, search_text, embedding_json\n") + f""",
     r AS (SELECT tenant_id, assertion_id, any_value(search_text) AS t, min(embedding_json) AS j FROM now GROUP BY ALL),
     e AS (SELECT *, {_TOKENS.format('t')} AS k, TRY_CAST(j AS DOUBLE[]) AS rv, list_transform(TRY_CAST(j AS DOUBLE[]), lambda x: CASE WHEN isfinite(x) THEN x ELSE 0 END) AS lv, CASE WHEN len(lv) = 64 THEN lv ELSE list_transform(range(64), lambda i: CAST(0 AS DOUBLE)) END AS ev, {_hash_sql("['storage', 'ledger']")} AS qv FROM r),
     f AS (SELECT tenant_id, assertion_id, len(list_intersect(['storage', 'ledger'], k)) / 2.0 AS lexical,
             CASE WHEN len(list_filter(rv, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(ev, ev) > 0 THEN list_inner_product(ev, qv) / (sqrt(list_inner_product(ev, ev)) * sqrt(list_inner_product(qv, qv))) END AS cosine FROM e)
"""


@query(_EMBEDDED + f""",
     c AS (SELECT * FROM (SELECT * FROM f WHERE cosine IS NOT NULL ORDER BY {_R6.format('cosine')} DESC, assertion_id LIMIT 200)
           UNION SELECT * FROM (SELECT * FROM f WHERE lexical = 1 ORDER BY assertion_id LIMIT 200)),
     z AS (SELECT tenant_id, assertion_id, {_R6.format('lexical')} AS lexical, {_R6.format('greatest(coalesce(cosine, 0.0), 0.0)')} AS vector, {_R6.format('0.45 * lexical + 0.55 * greatest(coalesce(cosine, 0.0), 0.0)')} AS score FROM c)
SELECT * FROM z WHERE lexical > 0 OR vector > 0 ORDER BY score DESC, assertion_id LIMIT 20""")
def search_two_branches(spark, d):
    """Candidates by vector and by all words, reranked together."""
    return search.two_branches(_current(spark, d), ["storage", "ledger"], S.hash_vector(["storage", "ledger"]))


@query(_SCORES + f"SELECT tenant_id, assertion_id, {_R6.format('lexical')} AS lexical, {_R6.format('vector')} AS vector, CAST(NULL AS INTEGER) AS distance, {_R6.format('0.45 * lexical + 0.55 * vector')} AS score FROM s WHERE {_R6.format('lexical')} > 0 OR {_R6.format('vector')} > 0 ORDER BY score DESC, assertion_id LIMIT 20")
def search_hybrid(spark, d):
    return search.hybrid(_searched(spark, d), QUERY)


_REACH = """,
     vis AS (SELECT DISTINCT tenant_id, assertion_id, subject_entity_id, object_entity_id FROM now),
     ed AS (SELECT DISTINCT * FROM (SELECT tenant_id, subject_entity_id AS src, object_entity_id AS dst FROM vis WHERE object_entity_id IS NOT NULL UNION ALL SELECT tenant_id, object_entity_id, subject_entity_id FROM vis WHERE object_entity_id IS NOT NULL) WHERE src <> dst),
     st AS (SELECT DISTINCT tenant_id, subject_entity_id AS start FROM vis WHERE {start}),
     l0 AS (SELECT tenant_id, start, start AS node, 0 AS distance FROM st),
     l1 AS (SELECT l0.tenant_id, l0.start, ed.dst AS node, 1 AS distance FROM l0 JOIN ed ON ed.tenant_id = l0.tenant_id AND ed.src = l0.node),
     l2 AS (SELECT l1.tenant_id, l1.start, ed.dst AS node, 2 AS distance FROM l1 JOIN ed ON ed.tenant_id = l1.tenant_id AND ed.src = l1.node),
     l3 AS (SELECT l2.tenant_id, l2.start, ed.dst AS node, 3 AS distance FROM l2 JOIN ed ON ed.tenant_id = l2.tenant_id AND ed.src = l2.node),
     re AS (SELECT tenant_id, start, node, CAST(min(distance) AS INTEGER) AS distance FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) WHERE distance <= {depth} GROUP BY ALL)
"""


def _reached(spark, d, depth):
    now = _current(spark, d).dropDuplicates(temporal.KEY)
    busiest = now.where("object_entity_id is not null").groupBy("subject_entity_id").count().orderBy(F.desc("count"), "subject_entity_id").first()
    starts = now.where(F.col("subject_entity_id") == (busiest["subject_entity_id"] if busiest else None)).select("tenant_id", F.col("subject_entity_id").alias("start"))
    return graph.distances(graph.entity_edges(now), starts, depth)


@query(_SCORES + _REACH.format(start=START, depth=2) + f""",
     h AS (SELECT s.tenant_id, s.assertion_id, min(re.distance) AS distance FROM s JOIN re ON re.tenant_id = s.tenant_id AND (re.node = s.subject_entity_id OR re.node = s.object_entity_id) GROUP BY ALL)
SELECT s.tenant_id, s.assertion_id, {_R6.format('lexical')} AS lexical, {_R6.format('vector')} AS vector, CAST(distance AS INTEGER) AS distance, {_R6.format('0.45 * lexical + 0.55 * vector + 0.1 / (1 + distance)')} AS score
FROM s JOIN h ON h.tenant_id = s.tenant_id AND h.assertion_id = s.assertion_id WHERE {_R6.format('lexical')} > 0 OR {_R6.format('vector')} > 0 ORDER BY score DESC, assertion_id LIMIT 20""")
def search_hybrid_graph(spark, d):
    return search.hybrid(_searched(spark, d), QUERY, reached=_reached(spark, d, 2))


@query(_NOW + _REACH.format(start=START, depth=3) + "SELECT tenant_id, start, node, distance FROM re")
def graph_distance(spark, d):
    return _reached(spark, d, 3)


@query(_NOW + _REACH.format(start="object_entity_id IS NOT NULL", depth=2) + "SELECT tenant_id, start, count(*) AS n_reached FROM re GROUP BY tenant_id, start")
def graph_reachable(spark, d):
    now = _current(spark, d)
    starts = now.where("object_entity_id is not null").select("tenant_id", F.col("subject_entity_id").alias("start"))
    return graph.distances(graph.entity_edges(now), starts).groupBy("tenant_id", "start").agg(F.count(F.lit(1)).alias("n_reached"))


_EDGES = """
WITH e AS (SELECT DISTINCT tenant_id, effect_id, instance_id, originating_revision, decision_assertion_id, policy_assertion_id, created_at FROM effect_intents),
     a AS (SELECT DISTINCT tenant_id, assertion_id, source_artifact_id, system_from FROM assertions),
     r AS (
       SELECT tenant_id, 'evidence_for' AS relation, 'artifact:' || source_artifact_id AS src, 'assertion:' || assertion_id AS dst, epoch_us(system_from) AS at_us FROM a WHERE source_artifact_id <> ''
       UNION ALL SELECT tenant_id, 'authorizes', 'assertion:' || decision_assertion_id, 'effect:' || effect_id, epoch_us(created_at) FROM e WHERE decision_assertion_id <> ''
       UNION ALL SELECT tenant_id, 'governs', 'assertion:' || policy_assertion_id, 'effect:' || effect_id, epoch_us(created_at) FROM e WHERE policy_assertion_id <> ''
       UNION ALL SELECT tenant_id, 'produces', 'workflow:' || instance_id || '@' || originating_revision, 'effect:' || effect_id, epoch_us(created_at) FROM e),
     l AS (SELECT *, 'edge_' || substr(sha256(concat(tenant_id, chr(0), relation, chr(0), src, chr(0), dst, chr(0))), 1, 32) AS edge_id FROM r WHERE src <> dst)
"""


def _lineage(spark, d):
    return graph.lineage(_assertions(spark, d), table(spark, d, "effect_intents"))


@query(_EDGES + "SELECT tenant_id, relation, src, dst, at_us, edge_id FROM l")
def lineage_edges(spark, d):
    return _lineage(spark, d).select("tenant_id", "relation", "src", "dst", "at_us", "edge_id")


@query(_EDGES + "SELECT tenant_id, relation, count(DISTINCT edge_id) AS n_edges, count(DISTINCT src) AS n_sources FROM l GROUP BY ALL")
def lineage_relations(spark, d):
    return _lineage(spark, d).groupBy("tenant_id", "relation").agg(F.count_distinct("edge_id").alias("n_edges"), F.count_distinct("src").alias("n_sources"))


@query(_EDGES + """,
     k AS (SELECT DISTINCT tenant_id, 'assertion:' || assertion_id AS node FROM assertions UNION SELECT DISTINCT tenant_id, 'artifact:' || artifact_id FROM artifacts
           UNION SELECT DISTINCT tenant_id, 'workflow:' || instance_id || '@' || revision FROM machine_history)
SELECT l.tenant_id, l.edge_id, l.src FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.tenant_id = l.tenant_id AND k.node = l.src)""")
def lineage_dangling(spark, d):
    ids = lambda t, *parts: table(spark, d, t).select("tenant_id", F.concat(*parts).alias("node"))
    nodes = ids("assertions", F.lit("assertion:"), "assertion_id").union(ids("artifacts", F.lit("artifact:"), "artifact_id")).union(ids("machine_history", F.lit("workflow:"), "instance_id", F.lit("@"), F.col("revision").cast("string")))
    return audit.without_parent(_lineage(spark, d), nodes, {"tenant_id": "tenant_id", "src": "node"}).select("tenant_id", "edge_id", "src")


def _trace(spark, d):
    first = table(spark, d, "effect_intents").where("decision_assertion_id is not null and policy_assertion_id is not null").agg(F.min(F.struct("effect_id", "tenant_id")).alias("x")).first()["x"]
    return graph.trace(spark, _lineage(spark, d), first["tenant_id"], "effect:" + first["effect_id"])


_TRACE = _EDGES + """,
     target AS (SELECT tenant_id, 'effect:' || effect_id AS node FROM e WHERE decision_assertion_id IS NOT NULL AND policy_assertion_id IS NOT NULL ORDER BY effect_id, tenant_id LIMIT 1),
     links AS (SELECT DISTINCT l.edge_id, l.relation, l.src, l.dst FROM l JOIN target t ON t.tenant_id = l.tenant_id),
     d0 AS (SELECT node FROM target),
     d1 AS (SELECT node FROM d0 UNION SELECT dst FROM links WHERE src IN (FROM d0) UNION SELECT src FROM links WHERE dst IN (FROM d0)),
     d2 AS (SELECT node FROM d1 UNION SELECT dst FROM links WHERE src IN (FROM d1) UNION SELECT src FROM links WHERE dst IN (FROM d1)),
     d3 AS (SELECT node FROM d2 UNION SELECT dst FROM links WHERE src IN (FROM d2) UNION SELECT src FROM links WHERE dst IN (FROM d2)),
     d4 AS (SELECT node FROM d3 UNION SELECT dst FROM links WHERE src IN (FROM d3) UNION SELECT src FROM links WHERE dst IN (FROM d3))
"""


@query(_TRACE + "SELECT node, CAST(min(d) AS INTEGER) AS depth FROM (SELECT node, 0 AS d FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3 UNION ALL SELECT node, 4 FROM d4) GROUP BY node")
def explain_trace_nodes(spark, d):
    return _trace(spark, d)[0]


@query(_TRACE + "SELECT edge_id, relation, src, dst FROM links WHERE src IN (FROM d3) OR dst IN (FROM d3)")
def explain_trace_edges(spark, d):
    return _trace(spark, d)[1]


@query("""
SELECT user_id, event_id, CAST(f AS INTEGER) AS first_rank, CAST(l AS INTEGER) AS last_rank, n AS n_in_group
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE f <= 10 OR l <= 10""")
def attempt_first_last_10(spark, d):
    return records.ends_of_group(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT tenant_id, instance_id, revision, new_state AS state, event_id FROM (SELECT DISTINCT tenant_id, instance_id, revision, new_state, event_id FROM machine_history)
QUALIFY row_number() OVER (PARTITION BY tenant_id, instance_id ORDER BY revision DESC, new_state DESC, event_id DESC) = 1""")
def workflow_head(spark, d):
    return records.head(table(spark, d, "machine_history"))


_CHAIN = """
WITH h AS (SELECT tenant_id, instance_id, revision, min(prior_state) AS p, min(struct_pack(p := prior_state, n := new_state)).n AS n FROM machine_history GROUP BY ALL),
     f AS (SELECT *, CASE WHEN revision = 1 THEN TRUE ELSE coalesce(lag(revision) OVER w = revision - 1 AND lag(n) OVER w = p, FALSE) END AS fits FROM h WINDOW w AS (PARTITION BY tenant_id, instance_id ORDER BY revision))
SELECT tenant_id, instance_id, revision, min(fits) OVER (PARTITION BY tenant_id, instance_id ORDER BY revision) AS accepted FROM f"""


@query(_CHAIN)
def workflow_accepted(spark, d):
    return records.accepted_chain(table(spark, d, "machine_history"))


@query("""
WITH h AS (SELECT tenant_id, instance_id, max(revision) AS revision, arg_max(new_state, revision) AS state FROM machine_history GROUP BY ALL)
SELECT i.tenant_id, i.instance_id, i.revision, h.revision AS history_revision FROM (SELECT DISTINCT tenant_id, instance_id, CAST(revision + CASE WHEN revision % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS revision, state FROM machine_instances) i
LEFT JOIN h ON h.tenant_id = i.tenant_id AND h.instance_id = i.instance_id WHERE h.revision IS NULL OR h.revision <> i.revision OR h.state <> i.state""")
def workflow_head_mismatch(spark, d):
    heads = records.head(table(spark, d, "machine_history")).select("tenant_id", "instance_id", F.col("revision").alias("history_revision"), F.col("state").alias("s_"))
    ahead = F.col("revision") + F.when(F.col("revision") % 5 == 0, 1).otherwise(0)  # every fifth is taken for one revision ahead
    rows = table(spark, d, "machine_instances").select("tenant_id", "instance_id", ahead.cast("int").alias("revision"), "state").distinct()
    return rows.join(heads, ["tenant_id", "instance_id"], "left").where("history_revision is null or history_revision <> revision or s_ <> state").select("tenant_id", "instance_id", "revision", "history_revision")


_PAGE = "SELECT effect_id, epoch_us(created_at) AS created_us FROM (SELECT DISTINCT effect_id, created_at FROM effect_intents WHERE tenant_id = 'tn_brine') {} ORDER BY created_at, effect_id LIMIT 100"


def _effects_of_tenant(spark, d, tenant: str = TENANT):
    return table(spark, d, "effect_intents").where(F.col("tenant_id") == tenant).select("effect_id", us("created_at").alias("created_us")).distinct()


@query(_PAGE.format(""))
def effects_page_first(spark, d):
    return records.page(_effects_of_tenant(spark, d), ["created_us", "effect_id"], 100)


@query(_PAGE.format("WHERE (created_at, effect_id) > (TIMESTAMPTZ '2024-01-10 00:00:00+00', 'eff_')"))
def effects_page_next(spark, d):
    return records.page(_effects_of_tenant(spark, d), ["created_us", "effect_id"], 100, (1704844800000000, "eff_"))


@query("SELECT tenant_id, idempotency_key, count(DISTINCT effect_id) AS n FROM effect_intents GROUP BY ALL HAVING n > 1")
def effect_duplicate_keys(spark, d):
    return records.repeated_keys(table(spark, d, "effect_intents"), ["tenant_id", "idempotency_key"], "effect_id")


@query(f"""
SELECT tenant_id, effect_id, epoch_us(created_at) AS created_us FROM (
  SELECT DISTINCT tenant_id, effect_id, created_at FROM effect_intents
  WHERE status IN ('planned', 'unknown') AND epoch_us(updated_at) + least(3600, 30 * CAST(pow(2, least(attempt_count, 6)) AS INTEGER)) * 1000000 <= epoch_us({_T}))
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, effect_id) <= 1""")
def effect_lease_next(spark, d):
    return folds.lease_next(table(spark, d, "effect_intents"), F.lit(AT).cast("timestamp")).select("tenant_id", "effect_id", us("created_at").alias("created_us"))


@query("SELECT tenant_id, CAST(row_number() OVER (ORDER BY CASE WHEN tenant_id > 'tn_ember' THEN 0 ELSE 1 END, tenant_id) AS INTEGER) AS turn FROM (SELECT DISTINCT tenant_id FROM effect_intents)")
def effect_tenant_rotation(spark, d, served: str = SERVED):
    return folds.rotation(table(spark, d, "effect_intents"), served)


@query("SELECT DISTINCT attempt_count, CAST(least(3600, 30 * pow(2, least(attempt_count, 6))) AS INTEGER) AS delay_s FROM effect_intents")
def effect_retry_delay(spark, d):
    return table(spark, d, "effect_intents").select("attempt_count", S.retry_seconds("attempt_count").alias("delay_s")).distinct()


_CODE = "CAST(200 + 12 * (event_id % 30) AS INTEGER)"


@query(f"""
SELECT event_id, CASE WHEN c BETWEEN 200 AND 299 AND event_id % 3 <> 0 THEN 'succeeded'
  WHEN c BETWEEN 200 AND 299 OR c IN (408, 409, 425, 429) OR c >= 500 OR (event_id % 2 = 0 AND c = 404) THEN 'unknown' ELSE 'failed' END AS outcome FROM (SELECT event_id, {_CODE} AS c FROM events)""")
def effect_classify(spark, d):
    mode = F.when(F.col("event_id") % 2 == 0, "reconcile").otherwise("deliver")
    return table(spark, d, "events").select("event_id", folds.classify(mode, F.expr("cast(200 + 12 * (event_id % 30) as int)"), F.col("event_id") % 3 != 0).alias("outcome"))


@query("""
SELECT tenant_id, coalesce(currency, '') AS currency, CAST(coalesce(sum(budget_amount) FILTER (status = 'succeeded'), 0) AS DECIMAL(30, 4))::VARCHAR AS settled, CAST(coalesce(sum(budget_amount) FILTER (status IN ('planned', 'unknown')), 0) AS DECIMAL(30, 4))::VARCHAR AS held,
       CAST(coalesce(sum(budget_amount) FILTER (status IN ('failed', 'cancelled')), 0) AS DECIMAL(30, 4))::VARCHAR AS released, count(*) AS n
FROM (SELECT DISTINCT tenant_id, effect_id, currency, status, budget_amount FROM effect_intents WHERE budget_amount IS NOT NULL) GROUP BY ALL""")
def budget_settlement(spark, d):
    """Amounts as text, which is exact on either side."""
    out = folds.totals_by_outcome(table(spark, d, "effect_intents"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("settled", "held", "released")})


@query("""
WITH r AS (SELECT l_partkey AS part, epoch_us(l_shipdate) AS ship_us, l_orderkey AS order_key, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS q, CAST(p_size AS BIGINT) * 8 AS cap FROM lineitem JOIN part ON p_partkey = l_partkey),
     g AS (SELECT part, max(cap) AS cap, list(struct_pack(ship_us := ship_us, order_key := order_key, line := line, q := q) ORDER BY ship_us, order_key, line, q) AS rows FROM r GROUP BY part),
     f AS (SELECT part, list_reduce(rows, lambda a, x: {'used': a.used + CASE WHEN x.q <= cap - a.used THEN x.q ELSE 0 END, 'n': a.n + CASE WHEN x.q <= cap - a.used THEN 1 ELSE 0 END}, {'used': CAST(0 AS BIGINT), 'n': 0}) AS s, len(rows) AS n_requests FROM g)
SELECT part, CAST(s.used AS BIGINT) AS used, CAST(s.n AS BIGINT) AS n_admitted, n_requests FROM f""")
def reservation_fold(spark, d):
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size").cast("long") * 8).alias("cap"))
    r = lines.select(F.col("l_partkey").alias("part"), us("l_shipdate").alias("ship_us"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("q")).join(parts, "part")
    out = folds.admit(r, ["part"], ["ship_us", "order_key", "line", "q"], "q", "cap")
    return out.groupBy("part").agg(F.max("used").alias("used"), F.sum(F.col("admitted").cast("long")).alias("n_admitted"), F.count(F.lit(1)).alias("n_requests"))


@query("""
SELECT tenant_id, idempotency_key, x.c AS created_us, x.effect_id AS effect_id FROM (SELECT tenant_id, idempotency_key, min(struct_pack(c := epoch_us(created_at), effect_id := effect_id)) AS x FROM effect_intents GROUP BY ALL)""")
def idempotency_first(spark, d):
    rows = table(spark, d, "effect_intents").withColumn("created_us", us("created_at"))
    return records.first_by_key(rows, ["tenant_id", "idempotency_key"], ["created_us", "effect_id"], ["created_us", "effect_id"])


@query("SELECT tenant_id, idempotency_key, count(DISTINCT sha256(concat(effect_type, chr(0), target, chr(0)))) AS n_requests FROM effect_intents GROUP BY ALL HAVING n_requests > 1")
def idempotency_conflicts(spark, d):
    return records.key_conflicts(table(spark, d, "effect_intents"), ["tenant_id", "idempotency_key"], S.sha_parts("effect_type", "target"))


@query("""
SELECT DISTINCT effect_id, sha256(concat(coalesce(outcome_json, ''), chr(0))) AS result_hash,
       'receipt_' || substr(sha256(concat(tenant_id, chr(0), purpose, chr(0), effect_id, chr(0), sha256(concat(coalesce(outcome_json, ''), chr(0))), chr(0))), 1, 32) AS receipt_id FROM effect_intents""")
def receipts(spark, d):
    return records.receipts(table(spark, d, "effect_intents"), ["tenant_id", "purpose", "effect_id"], F.col("outcome_json")).select("effect_id", "result_hash", "receipt_id").distinct()


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def rate_limit_window(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) <= 2).alias("admitted"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS admitted FROM events")
def rate_limit_minute(spark, d):
    return metrics.admitted_per_minute(table(spark, d, "events"), "event_type", "ts", 1, "event_id").select("event_id", "admitted")


def _histogram(spark, d):
    return metrics.histogram(table(spark, d, "events"), ["event_type"], "value")


_HIST = "SELECT event_type, le, n FROM (" + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in metrics.BOUNDS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type)"


@query(_HIST)
def latency_histogram(spark, d):
    return _histogram(spark, d)


@query(f"""SELECT 'event_value_bucket{{event_type="' || event_type || '",le="' || le || '"}} ' || n AS line FROM ({_HIST})""")
def metrics_lines(spark, d):
    return metrics.prometheus_lines(_histogram(spark, d), "event_value", ["event_type"])


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, median(value) AS median, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT tenant_id, predicate, median(authority) AS median_authority, count(*) AS n FROM (SELECT DISTINCT tenant_id, assertion_id, predicate, authority FROM assertions) GROUP BY ALL")
def median_by_group(spark, d):
    return temporal.once(_assertions(spark, d), temporal.KEY, ["predicate", "authority"]).groupBy("tenant_id", "predicate").agg(F.median("authority").alias("median_authority"), F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT DISTINCT tenant_id, effect_id, instance_id, originating_revision AS revision, decision_assertion_id, policy_assertion_id, created_at FROM effect_intents),
     a AS (SELECT DISTINCT tenant_id, assertion_id, system_from, system_to, status, source_artifact_id FROM assertions),
     h AS (SELECT DISTINCT tenant_id, instance_id, revision FROM machine_history)
SELECT e.tenant_id, e.effect_id, d.assertion_id IS NOT NULL AS has_decision,
       coalesce(d.status = 'active' AND d.system_from <= e.created_at AND (d.system_to IS NULL OR d.system_to > e.created_at), FALSE) AS decision_current,
       coalesce(d.assertion_id IS NOT NULL AND d.source_artifact_id IS NOT NULL, FALSE) AS decision_sourced,
       p.assertion_id IS NOT NULL AS has_policy, coalesce(p.status = 'active' AND p.system_from <= e.created_at AND (p.system_to IS NULL OR p.system_to > e.created_at), FALSE) AS policy_current,
       h.revision IS NOT NULL AS has_revision
FROM e LEFT JOIN a d ON d.tenant_id = e.tenant_id AND d.assertion_id = e.decision_assertion_id LEFT JOIN a p ON p.tenant_id = e.tenant_id AND p.assertion_id = e.policy_assertion_id
       LEFT JOIN h ON h.tenant_id = e.tenant_id AND h.instance_id = e.instance_id AND h.revision = e.revision""")
def audit_questions(spark, d):
    return audit.effect_evidence(table(spark, d, "effect_intents"), _assertions(spark, d), table(spark, d, "machine_history"))


@query("""
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, valid_from, valid_to, system_from, system_to, authority, strength_type, strength_json, supersedes_assertion_id AS up, source_artifact_id AS src FROM assertions)
SELECT 'valid interval' AS rule, count(*) FILTER (valid_to <= valid_from) AS n FROM a
UNION ALL SELECT 'system interval', count(*) FILTER (system_to <= system_from) FROM a
UNION ALL SELECT 'authority', count(*) FILTER (authority NOT BETWEEN 0 AND 100) FROM a
UNION ALL SELECT 'probability', count(*) FILTER (strength_type = 'probability' AND TRY_CAST(json_extract_string(strength_json, '$.value') AS DOUBLE) NOT BETWEEN 0 AND 1) FROM a
UNION ALL SELECT 'self supersession', count(*) FILTER (up = assertion_id) FROM a
UNION ALL SELECT 'empty reference', count(*) FILTER (src = '' OR up = '') FROM a""")
def integrity_checks(spark, d):
    return audit.violations(_assertions(spark, d))


@query("SELECT DISTINCT tenant_id, effect_id, instance_id FROM effect_intents e WHERE NOT EXISTS (SELECT 1 FROM machine_instances m WHERE m.revision <> 3 AND m.tenant_id = e.tenant_id AND m.instance_id = e.instance_id)")
def fk_orphans(spark, d):
    rows = table(spark, d, "effect_intents").select("tenant_id", "effect_id", "instance_id").distinct()
    kept = table(spark, d, "machine_instances").where("revision <> 3")  # those of revision 3 are taken for lost
    return audit.without_parent(rows, kept, {"tenant_id": "tenant_id", "instance_id": "instance_id"})


@query("SELECT max(t) AS latest_us FROM (SELECT max(epoch_us(system_from)) AS t FROM assertions UNION ALL SELECT max(epoch_us(created_at)) FROM artifacts UNION ALL SELECT max(epoch_us(created_at)) FROM effect_intents UNION ALL SELECT max(epoch_us(created_at)) FROM machine_history)")
def clock_seed(spark, d):
    return audit.latest_time((_assertions(spark, d), "system_from"), *((table(spark, d, t), "created_at") for t in ("artifacts", "effect_intents", "machine_history")))


@query("SELECT DISTINCT target, lower(regexp_extract(target, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin FROM effect_intents")
def target_origins(spark, d):
    return table(spark, d, "effect_intents").select("target", S.url_origin("target").alias("origin")).distinct()


@query("SELECT status, count(*) AS n FROM effect_intents GROUP BY status")
def read_only_sql(spark, d):
    table(spark, d, "effect_intents").createOrReplaceTempView("effect_intents_view")
    return read_sql(spark, "SELECT status, count(*) AS n FROM effect_intents_view GROUP BY status")


@query()
def context_bundle(spark, d):
    hits = [r.asDict() for r in search_hybrid(spark, d).collect()]
    claims = [r.asDict() for r in resolve_highest_authority(spark, d).orderBy(*resolve.CLAIM).limit(20).collect()]
    b = context.pack_context([("search", hits), ("resolutions", claims)], 6000)
    return spark.createDataFrame([(s["name"], s["complete"], s["characters"], s["text"]) for s in b["sections"]], "section string, complete boolean, characters int, text string")


@query(_DELIVERIES + """,
     q AS (SELECT tenant_id, artifact_id, created_at, concat(sha256(content), chr(0), media_type, chr(0), source_identity) AS body FROM deliveries),
     o AS (SELECT tenant_id, artifact_id, min(concat(content_hash, chr(0), 'text/ledger', chr(0), source_identity)) AS before FROM artifacts WHERE content_hash >= '5' AND content_hash < '6' GROUP BY ALL),
     f AS (SELECT q.tenant_id, q.artifact_id, coalesce(o.before, x.b) AS kept, o.before IS NOT NULL AS old FROM (SELECT tenant_id, artifact_id, min(struct_pack(a := created_at, b := body)).b AS b FROM q GROUP BY ALL) x JOIN (SELECT DISTINCT tenant_id, artifact_id FROM q) q ON q.tenant_id = x.tenant_id AND q.artifact_id = x.artifact_id LEFT JOIN o ON o.tenant_id = q.tenant_id AND o.artifact_id = q.artifact_id)
SELECT q.tenant_id, q.artifact_id, CASE WHEN count(*) FILTER (body <> kept) > 0 THEN 'conflict' WHEN bool_or(old) OR count(*) > 1 THEN 'replayed' ELSE 'inserted' END AS outcome, count(*) AS n_requests, count(*) FILTER (body <> kept) AS n_conflicts
FROM q JOIN f ON f.tenant_id = q.tenant_id AND f.artifact_id = q.artifact_id GROUP BY q.tenant_id, q.artifact_id""")
def intake_artifacts(spark, d):
    """Deliveries against a ledger that holds some artifacts under another type."""
    ledger = table(spark, d, "artifacts").where("content_hash >= '5' and content_hash < '6'").withColumn("media_type", F.lit("text/ledger"))
    return intake.put_artifacts(_deliveries(spark, d), ledger)


@query("""
WITH a AS (SELECT DISTINCT tenant_id, assertion_id, subject_entity_id AS s, predicate AS p, perspective AS v, valid_from, valid_to, system_from, system_to, authority, strength_type AS st, strength_json AS sj, source_artifact_id AS src, supersedes_assertion_id AS up FROM assertions),
     t AS (SELECT tenant_id, artifact_id, max(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS gone FROM artifacts GROUP BY ALL)
SELECT a.tenant_id, a.assertion_id,
  CASE WHEN a.valid_to <= a.valid_from THEN 'valid interval' WHEN a.authority NOT BETWEEN 0 AND 100 THEN 'authority'
       WHEN (a.st = 'probability' AND TRY_CAST(json_extract_string(a.sj, '$.value') AS DOUBLE) NOT BETWEEN 0 AND 1)
         OR (a.st = 'interval' AND TRY_CAST(json_extract_string(a.sj, '$.low') AS DOUBLE) > TRY_CAST(json_extract_string(a.sj, '$.high') AS DOUBLE))
         OR (a.st = 'evidence_count' AND TRY_CAST(json_extract_string(a.sj, '$.supporting') AS DOUBLE) > TRY_CAST(json_extract_string(a.sj, '$.considered') AS DOUBLE)) THEN 'strength'
       WHEN a.src IS NOT NULL AND t.gone IS NULL THEN 'source not found' WHEN t.gone = 1 THEN 'source deleted'
       WHEN a.up IS NOT NULL AND o.assertion_id IS NULL THEN 'predecessor not found'
       WHEN o.s <> a.s OR o.p <> a.p OR o.v <> a.v THEN 'predecessor of another claim'
       WHEN o.system_from > a.system_from OR o.system_to < a.system_from THEN 'predecessor not open' END AS error
FROM a LEFT JOIN a o ON o.tenant_id = a.tenant_id AND o.assertion_id = a.up LEFT JOIN t ON t.tenant_id = a.tenant_id AND t.artifact_id = a.src""")
def intake_assertions(spark, d):
    a = _assertions(spark, d)
    return intake.check_assertions(a, a, table(spark, d, "artifacts"))


@query(_EDGES + "SELECT relation, 'accepted' AS outcome, count(DISTINCT edge_id) AS n FROM l GROUP BY relation UNION ALL SELECT relation, 'wrong ends', count(DISTINCT edge_id) FROM l GROUP BY relation")
def intake_lineage(spark, d):
    """Every edge as it is, and turned round, which no relation here allows."""
    e = _lineage(spark, d)
    turned = e.select("tenant_id", "relation", F.col("dst").alias("src"), F.col("src").alias("dst"), "at_us", "edge_id")
    rows = intake.check_lineage(e.unionByName(turned))
    return rows.groupBy("relation", F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(F.count_distinct("edge_id").alias("n"))


@query("""
WITH r AS (SELECT DISTINCT tenant_id, effect_id, idempotency_key, created_at, concat(effect_type, chr(0), target, chr(0)) AS body FROM effect_intents),
     f AS (SELECT tenant_id, idempotency_key, min(struct_pack(a := created_at, b := effect_id, c := body)) AS f FROM r GROUP BY ALL)
SELECT r.tenant_id, r.effect_id, CASE WHEN r.effect_id = f.f.b THEN 'executed' WHEN r.body = f.f.c THEN 'replayed' ELSE 'conflict' END AS outcome
FROM r JOIN f ON f.tenant_id = r.tenant_id AND f.idempotency_key = r.idempotency_key""")
def idempotency_outcomes(spark, d):
    rows = table(spark, d, "effect_intents").select("tenant_id", "effect_id", "idempotency_key", "created_at", "effect_type", "target").distinct()
    return intake.replays(rows, ["tenant_id", "idempotency_key"], ["created_at", "effect_id"], S.sha_parts("effect_type", "target")).select("tenant_id", "effect_id", "outcome")


@query("""
SELECT 'timer-' || o_orderkey AS timer_id, epoch_us(o_orderdate) + (o_orderkey % 30) * 86400000000 AS due_us FROM orders
WHERE o_orderstatus = 'O' AND epoch_us(o_orderdate) + (o_orderkey % 30) * 86400000000 <= epoch_us(TIMESTAMP '1996-01-01') ORDER BY due_us, timer_id LIMIT 100""")
def timers_due_batch(spark, d):
    o = table(spark, d, "orders")
    timers = o.select(F.concat(F.lit("timer-"), F.col("o_orderkey").cast("string")).alias("timer_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("fired").alias("status"), (us("o_orderdate") + (F.col("o_orderkey") % 30) * 86_400_000_000).alias("due_at"))
    return intake.due_timers(timers, us(F.lit("1996-01-01").cast("timestamp"))).select("timer_id", F.col("due_at").alias("due_us"))


@query("""
WITH k AS (SELECT tenant_id, instance_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, instance_id, effect_id FROM effect_intents) GROUP BY ALL)
SELECT i.tenant_id, i.instance_id, i.machine_type, i.state, coalesce(k.n, 0) AS n_effects FROM machine_instances i LEFT JOIN k ON k.tenant_id = i.tenant_id AND k.instance_id = i.instance_id WHERE NOT i.terminal""")
def open_workflows(spark, d):
    n = table(spark, d, "effect_intents").groupBy("tenant_id", "instance_id").agg(F.count_distinct("effect_id").alias("n"))
    rows = table(spark, d, "machine_instances").where(~F.col("terminal")).select("tenant_id", "instance_id", "machine_type", "state")
    return rows.join(n, ["tenant_id", "instance_id"], "left").select("tenant_id", "instance_id", "machine_type", "state", F.coalesce("n", F.lit(0)).alias("n_effects"))


@query("""
SELECT lower(regexp_replace(trim(canonical_name), '\\s+', ' ', 'g')) AS name, count(DISTINCT (tenant_id, entity_id)) AS n_entities, count(DISTINCT canonical_name) AS n_spellings FROM entities GROUP BY 1""")
def entity_name_spellings(spark, d):
    name = F.lower(F.regexp_replace(F.trim("canonical_name"), r"\s+", " "))
    return table(spark, d, "entities").groupBy(name.alias("name")).agg(F.count_distinct("tenant_id", "entity_id").alias("n_entities"), F.count_distinct("canonical_name").alias("n_spellings"))
