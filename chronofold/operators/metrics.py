"""Counters, histograms, percentiles and rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bisect, quantile_cuts

# Upper bounds of the histogram's buckets.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120]


def histogram(df: DataFrame, by: list[str], value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """Cumulative counts per bound, a row each; the last bound is infinite. One
    aggregate with a column per bound, then unpivoted."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*by).agg(*sums, F.count(value).alias("all_"))
    pairs = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.coalesce(f"b{i}", F.lit(0)).alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all_").alias("n")))
    return g.select(*by, F.inline(pairs))


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], values_per_task: int = 1_000_000) -> DataFrame:
    """by, the nearest-rank percentiles of `at`, median (mean of the two middles), n.

    Null values do not count; a group of nulls only has n = 0 and nulls. Values of a large
    group are cut into blocks at quantiles; counts of the blocks tell in which the ranks
    lie, and only those blocks are sorted, so the result is exact and no task holds a group."""
    rows = df.select(*(F.col(c).alias(f"by{i}_") for i, c in enumerate(by)), F.col(value).alias("v_"))
    rows = rows.select(F.struct(*(f"by{i}_" for i in range(len(by)))).alias("g_"), "v_")  # structs compare with nulls inside
    some = rows.where("v_ is not null")
    cuts, most = quantile_cuts(some, ["g_"], "v_", values_per_task, "cuts_")
    if cuts is None:  # no group is large
        return df.groupBy(*by).agg(*(F.expr(f"percentile_disc({p}) within group (order by `{value}`)").alias(name) for name, p in at.items()), F.median(value).alias("median"), F.count(value).alias("n"))
    some = some.join(cuts, "g_", "left").select("g_", "v_", F.coalesce(bisect("cuts_", "v_", most), F.lit(0)).alias("b_"))
    counts = some.groupBy("g_", "b_", "v_").agg(F.count(F.lit(1)).alias("c_"))
    blocks = counts.groupBy("g_", "b_").agg(F.sum("c_").alias("s_"))
    group = Window.partitionBy("g_")
    blocks = blocks.select("g_", "b_", "s_", F.sum("s_").over(group).alias("n_"), F.coalesce(F.sum("s_").over(group.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    n = F.col("n_")
    ranks = {name: F.greatest(F.lit(1), F.ceil(F.lit(p) * n)) for name, p in at.items()} | {"low_": F.floor((n + 1) / 2), "high_": F.floor((n + 2) / 2)}
    want = blocks.select("g_", "b_", "before_", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))).alias("w_"), "s_")
    want = want.where((F.col("w_.rank") > F.col("before_")) & (F.col("w_.rank") <= F.col("before_") + F.col("s_"))).groupBy("g_", "b_").agg(F.collect_list(F.struct(F.col("w_.name").alias("name"), (F.col("w_.rank") - F.col("before_")).alias("rank"))).alias("want_"))
    up_to = F.sum("c_").over(Window.partitionBy("g_", "b_").orderBy("v_"))
    inside = counts.join(want, ["g_", "b_"]).withColumn("up_", up_to).withColumn("w_", F.explode("want_")).where((F.col("w_.rank") <= F.col("up_")) & (F.col("w_.rank") > F.col("up_") - F.col("c_")))
    pick = lambda name: F.max(F.when(F.col("w_.name") == name, F.col("v_")))
    found = inside.groupBy("g_").agg(*(pick(k).alias(k) for k in ranks))
    total = rows.groupBy("g_").agg(F.count("v_").alias("n"))
    out = total.join(found, "g_", "left")
    return out.select(*(F.col(f"g_.by{i}_").alias(c) for i, c in enumerate(by)), *at, ((F.col("low_") + F.col("high_")) / 2).alias("median"), "n")


def admitted_per_minute(df: DataFrame, key: str, ts: str, limit: int, tie: str) -> DataFrame:
    """Fixed-window rate limit: the first rows of a key in each minute are admitted."""
    w = Window.partitionBy(key, F.date_trunc("minute", ts)).orderBy(ts, tie)
    return df.withColumn("admitted", F.row_number().over(w) <= limit)


def prometheus_lines(hist: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Text exposition of a histogram, one line a row."""
    pairs = [F.concat(F.lit(c + '="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in [*labels, "le"]]
    return hist.select(F.concat(F.lit(name + "_bucket{"), F.concat_ws(",", *pairs), F.lit("} "), F.col("n").cast("string")).alias("line"))
