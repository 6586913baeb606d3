"""Keyed records: latest state, immutable artifacts, idempotency, receipts, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import make_id, sha_parts


def entity_heads(entities: DataFrame) -> DataFrame:
    """Type and name as written last, and the first creation time, per entity."""
    last = F.max(F.struct("created_at", "canonical_name", "entity_type"))
    g = entities.groupBy("tenant_id", "entity_id").agg(last.alias("x"), F.min("created_at").alias("first"))
    return g.select("tenant_id", "entity_id", F.col("x.entity_type").alias("entity_type"), F.col("x.canonical_name").alias("canonical_name"), F.unix_micros("first").alias("created_us"))


def artifact_heads(artifacts: DataFrame) -> DataFrame:
    """One row per artifact, with the number of copies delivered."""
    return artifacts.groupBy("tenant_id", "artifact_id").agg(F.min("content_hash").alias("content_hash"), F.count(F.lit(1)).alias("n_copies"))


def artifact_conflicts(artifacts: DataFrame) -> DataFrame:
    """Artifact ids whose copies differ in hash, media type or source."""
    g = artifacts.groupBy("tenant_id", "artifact_id").agg(*(F.count_distinct(c).alias("n_" + c) for c in ("content_hash", "media_type", "source_identity")))
    return g.where("n_content_hash > 1 or n_media_type > 1 or n_source_identity > 1")


def shared_content(artifacts: DataFrame) -> DataFrame:
    """Equal content under several ids of a tenant."""
    g = artifacts.groupBy("tenant_id", "content_hash").agg(F.count_distinct("artifact_id").alias("n_ids"), F.min("artifact_id").alias("first_id"))
    return g.where("n_ids > 1")


def content_ids(artifacts: DataFrame) -> DataFrame:
    """The content-addressed id of every artifact."""
    rows = artifacts.select("tenant_id", "artifact_id", "source_identity", F.sha2("content", 256).alias("sha")).distinct()
    return rows.select("tenant_id", "artifact_id", make_id("artifact", "tenant_id", "source_identity", "sha", digits=24).alias("derived_id"), "sha")


def first_by_key(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The first row of each key by order: one aggregate, no sort and no window."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in cols))


def key_conflicts(df: DataFrame, keys: list[str], request: Column) -> DataFrame:
    """Keys that were used for different requests."""
    return df.select(*keys, request.alias("r")).groupBy(*keys).agg(F.count_distinct("r").alias("n_requests")).where("n_requests > 1")


def repeated_keys(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(record).alias("n")).where("n > 1")


def receipts(df: DataFrame, parts: list[str], result: Column) -> DataFrame:
    """A receipt id over the parts and the hash of the result, for each row."""
    return df.withColumn("result_hash", sha_parts(result)).withColumn("receipt_id", make_id("receipt", *parts, "result_hash"))


def page(df: DataFrame, order: list[str], limit: int | None, after: tuple | None = None) -> DataFrame:
    """Keyset paging: rows after the cursor in order, all of them if limit is None."""
    if after is not None:
        df = df.where(F.struct(*order) > F.struct(*(F.lit(a).cast(df.schema[o].dataType).alias(o) for a, o in zip(after, order))))
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def ends_of_group(df: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """The first and last n rows of each group, with the size of the group. Either end is a
    top n, of which each task keeps n rows a group before anything is moved."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in_group"))

    def end(name: str, by: list) -> DataFrame:
        top = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(name) <= n)
        return top.join(size, keys)

    first = end("first_rank", order).withColumn("last_rank", (F.col("n_in_group") - F.col("first_rank") + 1).cast("int"))
    last = end("last_rank", [F.desc(o) for o in order]).withColumn("first_rank", (F.col("n_in_group") - F.col("last_rank") + 1).cast("int")).where(F.col("first_rank") > n)
    return first.unionByName(last)


def head(history: DataFrame) -> DataFrame:
    """The row of the largest revision per instance."""
    return history.groupBy("tenant_id", "instance_id").agg(F.max(F.struct("revision", "new_state", "event_id")).alias("x")).select("tenant_id", "instance_id", F.col("x.revision").alias("revision"), F.col("x.new_state").alias("state"), F.col("x.event_id").alias("event_id"))


def accepted_chain(history: DataFrame) -> DataFrame:
    """Optimistic transitions, see agency.transitions: a rejected one changes nothing, and
    later ones go on from the head it left. Equal rows count once."""
    from .agency import transitions

    order = ["revision", "prior_state", "new_state"]
    return transitions(history, order).select("tenant_id", "instance_id", "revision", "accepted")
