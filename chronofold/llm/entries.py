"""Queries of this subpackage over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import mixing, neighbours, packing, toxicity
from .tokens import count_tokens


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "assertions"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar assertions of each with a usable vector, however far."""
    near = neighbours.similar_assertions(table(spark, d, "assertions"), **neighbours.FAR)
    return near.select("id", "neighbour", "rank", "cosine").toDF("assertion_id", "neighbour_id", "rank", "cosine")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"), "doc_id", "text", ("source",))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text packed once per capacity."""
    return packing.assign(_sizes(spark, d), table(spark, d, "pack_targets"), tiered=False)


def p6_pack_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Every text packed once, in the tier of its length or in a gap of a longer one."""
    return packing.assign(_sizes(spark, d), table(spark, d, "pack_targets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p6_pack(spark, d))


def p6_tiers_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p6_pack_tiers(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "source_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "source_targets"))[1]


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"), keep=("source",))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_neighbours, p6_pack_tiers, p6_tiers_report, p6_pack, p6_report, p7_mix, p7_report, p8_found, p8_scores, p8_report)}


_VECTORS = """
WITH r AS (SELECT DISTINCT tenant_id, assertion_id, embedding_json AS j FROM assertions),
     v AS (SELECT tenant_id, assertion_id, any_value(TRY_CAST(j AS DOUBLE[])) AS x FROM r
           WHERE json_valid(j) AND json_type(TRY_CAST(j AS JSON)) = 'ARRAY' AND json_array_length(TRY_CAST(j AS JSON)) = 64
             AND len(list_filter(json_extract(TRY_CAST(j AS JSON), '$[*]'), lambda e: json_type(e) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0 GROUP BY ALL),
     u AS (SELECT tenant_id, assertion_id, list_transform(x, lambda e: e / sqrt(list_inner_product(x, x))) AS x FROM v WHERE len(list_filter(x, lambda e: NOT isfinite(e))) = 0 AND list_inner_product(x, x) > 0),
     p AS (SELECT a.tenant_id, a.assertion_id AS id, b.assertion_id AS neighbour, list_inner_product(a.x, b.x) AS cosine FROM u a JOIN u b ON b.tenant_id = a.tenant_id AND b.assertion_id <> a.assertion_id),
     n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY tenant_id, id ORDER BY cosine DESC, neighbour) <= 5)
"""


def oracle_sql() -> dict[str, str]:
    """Only these two are functions of the tables that SQL can state: brute force over all
    pairs of a tenant, against which the index is compared at sf0.01."""
    return {
        "p2_found": _VECTORS + "SELECT DISTINCT least(id, neighbour) AS assertion_id_a, greatest(id, neighbour) AS assertion_id_b FROM n WHERE cosine >= 0.90",
    }
