"""Bitemporal selection over an append-only ledger of assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bisect, quantile_cuts, us, visible

KEY = ["tenant_id", "assertion_id"]


def once(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row per key; redelivered copies are alike in cols (the largest value of
    each column is kept), and the aggregate combines on the map side."""
    return df.groupBy(*keys).agg(*(F.max(c).alias(c) for c in cols))


def holds(t: Column, start: str, end: str) -> Column:
    """start <= t < end, a null end is open."""
    return (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def as_of(assertions: DataFrame, system_at: Column | str, valid_at: Column | str | None = None, **equal: str) -> DataFrame:
    """Visible assertions valid at valid_at (default system_at) as recorded at
    system_at. equal: further column = value filters; all of them reach the scan."""
    s = F.lit(system_at).cast("timestamp") if isinstance(system_at, str) else system_at
    v = s if valid_at is None else F.lit(valid_at).cast("timestamp") if isinstance(valid_at, str) else valid_at
    out = assertions.where(visible() & holds(v, "valid_from", "valid_to") & holds(s, "system_from", "system_to"))
    for c, x in equal.items():
        out = out.where(F.col(c) == x)
    return out


def top_by_authority(df: DataFrame, limit: int = 100) -> DataFrame:
    """Authority, then latest recorded; limit is clamped to 1..1000."""
    return df.orderBy(F.desc("authority"), F.desc("system_from"), "assertion_id").limit(max(1, min(1000, limit)))


def timeline(assertions: DataFrame, versions_per_task: int = 1_000_000) -> DataFrame:
    """Recorded versions in order within their claim, with the next one's time. A claim of
    many versions is cut into blocks of time; each block carries the number of versions
    before it and the first time after it."""
    claim = ["tenant_id", "subject_entity_id", "predicate", "perspective"]
    rows = once(assertions, KEY, [*claim[1:], "system_from"]).select(F.struct(*claim).alias("g_"), "assertion_id", us("system_from").alias("from_us"))  # structs compare with nulls inside
    cuts, most = quantile_cuts(rows, ["g_"], "from_us", versions_per_task, "cuts_")
    block = F.lit(0) if cuts is None else F.coalesce(bisect("cuts_", "from_us", most), F.lit(0))
    rows = (rows if cuts is None else rows.join(cuts, "g_", "left")).select("g_", "assertion_id", "from_us", block.alias("block_"))
    w = Window.partitionBy("g_", "block_").orderBy("from_us", "assertion_id")
    rows = rows.withColumn("no_", F.row_number().over(w)).withColumn("next_us", F.lead("from_us").over(w))
    number, later = F.col("no_"), F.col("next_us")
    if cuts is not None:
        across = Window.partitionBy("g_").orderBy("block_")
        blocks = rows.groupBy("g_", "block_").agg(F.count(F.lit(1)).alias("n_"), F.min("from_us").alias("first_"))
        blocks = blocks.select("g_", "block_", F.coalesce(F.sum("n_").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"), F.lead("first_").over(across).alias("after_"))
        rows = rows.join(blocks, ["g_", "block_"])
        number, later = (F.col("base_") + F.col("no_")).cast("int"), F.coalesce("next_us", "after_")
    return rows.select("g_.tenant_id", "assertion_id", number.alias("version_no"), "from_us", later.alias("next_us"))


def derived_system_to(assertions: DataFrame) -> DataFrame:
    """system_to as stored, else the first successor's system_from."""
    rows = once(assertions, KEY, ["system_from", "system_to", "supersedes_assertion_id"])
    later = rows.where("supersedes_assertion_id is not null").groupBy("tenant_id", F.col("supersedes_assertion_id").alias("assertion_id")).agg(F.min("system_from").alias("closed_by"))
    return rows.join(later, KEY, "left").select("tenant_id", "assertion_id", us(F.coalesce("system_to", "closed_by")).alias("system_to_us"))


def supersession_faults(assertions: DataFrame) -> DataFrame:
    """Rows whose named predecessor is not a valid one, with the first reason."""
    rows = once(assertions, KEY, ["subject_entity_id", "predicate", "perspective", "system_from", "supersedes_assertion_id"])
    prior = rows.select("tenant_id", F.col("assertion_id").alias("supersedes_assertion_id"), *(F.col(c).alias("p_" + c) for c in ("subject_entity_id", "predicate", "perspective", "system_from")))
    j = rows.where("supersedes_assertion_id is not null").join(prior, ["tenant_id", "supersedes_assertion_id"], "left")
    reason = (
        F.when(F.col("p_system_from").isNull(), "absent")
        .when(F.col("supersedes_assertion_id") == F.col("assertion_id"), "self")
        .when((F.col("p_subject_entity_id") != F.col("subject_entity_id")) | (F.col("p_predicate") != F.col("predicate")) | (F.col("p_perspective") != F.col("perspective")), "other claim")
        .when(F.col("p_system_from") > F.col("system_from"), "later")
    )
    return j.select("tenant_id", "assertion_id", reason.alias("reason")).where("reason is not null")


def status_counts(assertions: DataFrame) -> DataFrame:
    return assertions.groupBy("status").agg(F.count_distinct(*KEY).alias("n"), F.max(visible().cast("int")).alias("visible"))
