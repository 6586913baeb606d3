import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronofold.operators import intervals
from chronofold.operators.common import FOREVER

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, a timestamp, z timestamp, start_us string, block_ int"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def us(t):
    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000


def _brute(rows):
    gaps, periods = set(), set()
    for k in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((us(a), FOREVER if z is None else us(z)) for kk, a, z in rows if kk == k and a is not None and (z is None or z > a))
        islands = []
        for a, z in iv:
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], z)
            else:
                islands.append([a, z])
        gaps |= {(k, x[1], y[0]) for x, y in zip(islands, islands[1:])}
        periods |= {(k, i + 1, a, None if z == FOREVER else z) for i, (a, z) in enumerate(islands)}
    return gaps, periods


@pytest.mark.parametrize("cap", [200_000, 6])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, cap, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(70):
        a = r.randint(0, 200)
        rows.append((r.choice(["hot"] * 5 + ["x", "y", None]), at(r.choice([a, a, a, None])), at(r.choice([a + r.randint(-2, 8), a + r.randint(0, 3), None if r.random() < 0.03 else a + 1]))))
    rows += [("same", at(5), at(6 + i % 3)) for i in range(20)] + rows[:9]
    df = spark.createDataFrame([(*x, "s", 7) for x in rows], SCHEMA).drop("start_us", "block_").withColumnRenamed("k", "key")
    gaps, periods = _brute(rows)
    assert {tuple(x) for x in intervals.gaps(df, ["key"], "a", "z", cap).collect()} == gaps
    assert {tuple(x)[:4] for x in intervals.periods(df, ["key"], "a", "z", cap).collect()} == periods


def test_touching_nested_and_empty(spark):
    df = spark.createDataFrame([("k", at(0), at(5)), ("k", at(1), at(2)), ("k", at(5), at(6)), ("k", at(8), None)], "key string, a timestamp, z timestamp")
    assert [tuple(r)[1:] for r in intervals.gaps(df, ["key"], "a", "z").collect()] == [(us(at(6)), us(at(8)))]
    assert intervals.gaps(df.limit(0), ["key"], "a", "z").count() == 0
    assert intervals.periods(df.limit(0), ["key"], "a", "z").count() == 0


def test_n_intervals_does_not_depend_on_the_size(spark):
    rows = [("hot", at(i % 4), at(i % 4 + 1 + i % 3)) for i in range(20)] + [("hot", at(20), at(21 + i)) for i in range(3)] + [("x", at(1), at(2))] * 2
    df = spark.createDataFrame(rows, "key string, a timestamp, z timestamp")
    want = {("hot", 1): 20, ("hot", 2): 3, ("x", 1): 2}
    for cap in (200_000, 6):
        assert {(r["key"], r["period_no"]): r["n_intervals"] for r in intervals.periods(df, ["key"], "a", "z", cap).collect()} == want


def test_bisect_and_cuts(spark):
    from chronofold.operators.common import bisect, quantile_cuts

    cuts = [1, 3, 3, 7, 9]
    df = spark.range(12).withColumn("cuts", F.array(*(F.lit(c) for c in cuts)).cast("array<long>"))
    assert [r[0] for r in df.select(bisect("cuts", "id", 5)).collect()] == [sum(c <= i for c in cuts) for i in range(12)]
    assert spark.range(1).select(bisect(F.array().cast("array<long>"), "id", 5)).first()[0] == 0
    points = spark.range(1000).select(F.when(F.col("id") < 900, "big").when(F.col("id") < 970, "mid").otherwise("cold").alias("k"), "id")
    table, most = quantile_cuts(points, ["k"], "id", 50, "c")
    got = {r["k"]: r["c"] for r in table.collect()}
    assert most == 18 and set(got) == {"big", "mid"} and len(got["big"]) == 17 and len(got["mid"]) == 1
    assert max(b - a for a, b in zip([0, *got["big"]], [*got["big"], 900])) <= 60
    assert quantile_cuts(points, ["k"], "id", 5000, "c") == (None, 0)
