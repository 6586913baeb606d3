"""Overlapping and gapped time intervals, as islands and gaps.

Sort by start per entity, compare each start with the running maximum of the
ends before it, label islands by a running count, aggregate. All in the JVM.

A key with more rows than rows_per_task is cut into blocks of its start times at
its own quantiles; repeated starts are aggregated first, so a block is bounded
even if all rows start at once. Each block carries the largest end of the blocks
before it, so the comparison is the same as over the whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FOREVER, bisect, quantile_cuts, us, visible

ROWS_PER_TASK = 200_000


def _sorted_starts(df: DataFrame, keys: list[str], start: str, end: str, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """keys, start_us, end_us, n_ (rows that it stands for), reach (largest end before,
    null at the first start, all as micros), block_."""
    rows = df.select(*keys, us(start).alias("start_us"), F.coalesce(us(end), F.lit(FOREVER)).alias("end_us")).dropna(subset=[*keys, "start_us"]).where("end_us > start_us").withColumn("n_", F.lit(1).cast("long"))
    cuts, most = quantile_cuts(rows, keys, "start_us", rows_per_task, "cuts_")
    if cuts is None:
        rows = rows.withColumn("block_", F.lit(0))
    else:
        cold = rows.join(cuts.select(*keys), keys, "left_anti").withColumn("block_", F.lit(0))
        hot = rows.join(cuts.select(*keys), keys, "left_semi").groupBy(*keys, "start_us").agg(F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n_"))
        rows = cold.unionByName(hot.join(cuts, keys).withColumn("block_", bisect("cuts_", "start_us", most)).drop("cuts_"))
    inside = Window.partitionBy(*keys, "block_").orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("end_us").over(inside))
    if cuts is not None:
        before = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys, "block_").agg(F.max("end_us").alias("e_")).select(*keys, "block_", F.max("e_").over(before).alias("carry_")).where("carry_ is not null")
        rows = rows.join(ends, [*keys, "block_"], "left").withColumn("reach", F.greatest("reach", "carry_")).drop("carry_")
    return rows


def gaps(df: DataFrame, keys: list[str], start: str, end: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """keys, gap_from_us, gap_to_us: the maximal spans between covered times that
    no interval covers. Touching intervals leave no gap; rows with a null key or
    start, or an end not after the start, count for nothing; a null end is open."""
    rows = _sorted_starts(df, keys, start, end, rows_per_task)
    return rows.where("start_us > reach").select(*keys, F.col("reach").alias("gap_from_us"), F.col("start_us").alias("gap_to_us"))


def periods(df: DataFrame, keys: list[str], start: str, end: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """keys, period_no (from 1), from_us, to_us (null: open), n_intervals: the
    continuous periods of each key. The same rows count as in gaps; repeated rows
    all count in n_intervals."""
    rows = _sorted_starts(df, keys, start, end, rows_per_task)
    opens = F.when(F.col("reach").isNull() | (F.col("start_us") > F.col("reach")), 1).otherwise(0)
    # Of equal intervals the one that opened a period has the smallest reach and stays first.
    inside = Window.partitionBy(*keys, "block_").orderBy("start_us", "end_us", F.col("reach").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens_", opens).withColumn("in_block_", F.sum("opens_").over(inside))
    before = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*keys, "block_", "in_block_").agg(F.min("start_us").alias("s_"), F.max("end_us").alias("e_"), F.sum("n_").alias("n_"), F.sum("opens_").alias("o_"))
    base = pieces.groupBy(*keys, "block_").agg(F.sum("o_").alias("b_")).select(*keys, "block_", F.coalesce(F.sum("b_").over(before), F.lit(0)).alias("base_"))
    whole = pieces.join(base, [*keys, "block_"]).withColumn("period_no", (F.col("base_") + F.col("in_block_")).cast("long"))
    out = whole.groupBy(*keys, "period_no").agg(F.min("s_").alias("from_us"), F.max("e_").alias("e_"), F.sum("n_").alias("n_intervals"))
    return out.select(*keys, "period_no", "from_us", F.when(F.col("e_") != FOREVER, F.col("e_")).alias("to_us"), "n_intervals")


CLAIM = ["tenant_id", "subject_entity_id", "predicate"]


def assertion_gaps(assertions: DataFrame) -> DataFrame:
    return gaps(assertions.where(visible()), CLAIM, "valid_from", "valid_to")


def assertion_periods(assertions: DataFrame) -> DataFrame:
    return periods(assertions.where(visible()), CLAIM, "valid_from", "valid_to")
