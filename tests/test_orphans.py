import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.operators import orphans
from chronofold.operators.orphans import Bitmap

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=60), st.sets(st.integers(0, 300_000), max_size=60), st.booleans())
def test_bitmap_equals_sets(a, b, dense):
    if dense:
        a, b = a | set(range(65_000, 75_000)), b | set(range(70_000, 90_000, 2))
    x, y = Bitmap(np.array(sorted(a), np.int64)), Bitmap(np.array(sorted(b), np.int64))
    assert set(x.decode().tolist()) == a
    assert set(x.and_not(y).decode().tolist()) == a - b
    assert set(x.union(y).decode().tolist()) == a | b


def _case(spark, seed=1, n=300):
    r = random.Random(seed)
    day = lambda: T0 + timedelta(days=r.randint(0, 120))
    parents = [(r.choice("tu"), f"k{i}", r.choice([True, False, False, None]), day()) for i in range(40)]
    refs = [(r.choice("tu"), r.choice([None, "", "gone", "k1", "k1", "k1", f"k{r.randrange(50)}"]), f"r{i}", day(), 5) for i in range(n)]
    parents = list({(p[0], p[1]): p for p in parents}.values())
    by = {(s, k): (g, t) for s, k, g, t in parents}
    want = set()
    for s, k, rid, t, _ in refs:
        if k is None:
            continue
        if (s, k) not in by:
            want.add(("f", rid, "missing"))
        elif by[s, k][0]:
            want.add(("f", rid, "deleted"))
        elif by[s, k][1] > t:
            want.add(("f", rid, "late"))
    R = spark.createDataFrame(refs + refs[:20], "scope string, key string, record_id string, at timestamp, gone int")
    P = spark.createDataFrame(parents + parents[:5], "scope string, key string, gone boolean, at timestamp")
    return R, P, want


@pytest.mark.parametrize("split,rng", [(50_000, 65_536), (10, 30)])
def test_equals_brute_force(spark, monkeypatch, split, rng):
    monkeypatch.setattr(orphans, "REFS_PER_SPLIT", split)
    monkeypatch.setattr(orphans, "ROWS_PER_RANGE", rng)
    R, P, want = _case(spark)
    got = orphans.find({"f": R}, {"p": P}, {"f": "p"})
    rows = [(r["ref_field"], r["record_id"], r["reason"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sum(r["n_records"] for r in orphans.report(got).collect()) == len(want)


def test_two_fields_two_parents_and_empty(spark):
    R, P, want = _case(spark, 2, 60)
    got = {(r["ref_field"], r["reason"]) for r in orphans.find({"f": R, "g": R}, {"p": P, "none": P.limit(0)}, {"f": "p", "g": "none"}).collect()}
    assert ("g", "missing") in got and ("g", "late") not in got
    assert orphans.find({"f": R.limit(0)}, {"p": P}, {"f": "p"}).count() == 0
    assert orphans.find({"f": R}, {"p": P.limit(0)}, {"f": "p"}).where("reason <> 'missing'").count() == 0
