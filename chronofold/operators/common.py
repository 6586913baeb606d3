"""Shared pieces: exact micros, visibility, and splitting of hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An open interval ends here.
FOREVER = 2**63 - 1
#: More hot keys than this are joined by shuffle instead of by broadcast.
MAX_BROADCAST_KEYS = 10_000


def us(c: Column | str) -> Column:
    """Microseconds since 1970 UTC of a timestamp, with or without time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def visible(status: str = "status") -> Column:
    """Neither quarantined nor deleted; a null status counts as visible."""
    return F.col(status).isNull() | ~F.col(status).isin("quarantined", "deleted")  # reaches the scan


def fold_key(*cols: str) -> Column:
    """One string that is equal exactly if all the columns are (length-prefixed)."""
    parts = reduce(list.__add__, ([F.length(c).cast("string"), F.lit(":"), F.col(c)] for c in cols))
    return F.concat(*parts)


def hot_splits(df: DataFrame, keys: list[str], cap: int, name: str) -> DataFrame | None:
    """keys and the number of parts, for keys with more than cap rows; None if
    there are none. Counting combines on the map side. Hot keys number at most
    rows / cap; up to MAX_BROADCAST_KEYS come back as a table that may be
    broadcast, more stay a distributed table that is joined by shuffle."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > cap).select(*keys, F.ceil(F.col("n_") / cap).cast("int").alias(name))
    few = hot.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not few:
        return None
    if len(few) <= MAX_BROADCAST_KEYS:
        return F.broadcast(df.sparkSession.createDataFrame(few, hot.schema))
    return hot


def with_splits(df: DataFrame, hot: DataFrame | None, keys: list[str], name: str) -> DataFrame:
    """df with the number of parts of its key, 1 where the key is not hot."""
    if hot is None:
        return df.withColumn(name, F.lit(1))
    return df.join(hot, keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def bisect(cuts: Column | str, x: Column | str, most: int) -> Column:
    """How many of the sorted cuts are at most x, by halving; most is the largest number of cuts."""
    cuts, x = (F.col(c) if isinstance(c, str) else c for c in (cuts, x))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(cuts, mid) <= x
        lo = F.when(s["lo"] < s["hi"], F.when(below, mid + 1).otherwise(s["lo"])).otherwise(s["lo"])
        hi = F.when(s["lo"] < s["hi"], F.when(below, s["hi"]).otherwise(mid)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve)["lo"]


def quantile_cuts(points: DataFrame, keys: list[str], point: str, cap: int, name: str) -> tuple[DataFrame | None, int]:
    """(keys, name: sorted cuts that part the points of a key into runs of about cap), for
    keys with more than cap points, and the most cuts of a key; None if there are no such
    keys. Up to MAX_BROADCAST_KEYS cuts in all come back as a table that may be broadcast."""
    points = points.select(*keys, F.col(point).alias("point_"))
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points_")).where(F.col("n_points_") > cap)
    parts = F.ceil(F.col("n_points_") / cap).cast("int")
    size = counts.agg(F.max(parts).alias("most"), F.sum(parts).alias("all")).first()
    if size["most"] is None:
        return None, 0
    most = size["most"]
    grid = F.percentile_approx("point_", [i / most for i in range(1, most)], 10 * most)
    every = points.join(counts, keys).groupBy(*keys).agg(grid.alias("grid_"), F.first(parts).alias("parts_"))
    # A key with fewer parts than the largest takes each so many-th of the grid.
    picked = F.transform(F.sequence(F.lit(1), F.col("parts_") - 1), lambda i: F.get("grid_", F.greatest(F.lit(0), F.floor(i * most / F.col("parts_")).cast("int") - 1)))
    cuts = every.select(*keys, F.array_distinct(picked).alias(name))
    if size["all"] <= MAX_BROADCAST_KEYS:
        return F.broadcast(points.sparkSession.createDataFrame(cuts.collect(), cuts.schema)), most
    return cuts, most
