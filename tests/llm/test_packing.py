import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import entries, packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=60), st.sampled_from([[32], [16, 64], [16, 64, 256]]))
def test_pack_places_every_token_once(sizes, caps):
    made = packing.pack(sizes, caps)
    got = {}
    for cap, inside in made:
        assert cap in caps and inside and sum(p[3] for p in inside) <= cap
        for i, part, start, n in inside:
            got.setdefault(i, []).append((part, start, n))
    for i, n in enumerate(sizes):
        parts = sorted(got.get(i, []))
        assert sum(p[2] for p in parts) == n
        assert [p[0] for p in parts] == list(range(len(parts)))
        at = 0
        for _, start, length in parts:
            assert start == at
            at += length
        if n <= max(caps):
            assert len(parts) <= 1
        else:
            assert all(p[2] == max(caps) for p in parts[:-1])


def test_fill_is_near_the_bound():
    import random

    r = random.Random(1)
    sizes = [r.randint(20, 3000) for _ in range(3000)]
    made = packing.pack(sizes, [512, 2048, 8192])
    assert sum(c for c, _ in made) <= 1.01 * sum(sizes)


def test_step_groups_are_balanced():
    groups = packing.step_groups([100, 90, 80, 70, 60, 50, 40, 30], 4)
    sums = [sum(f for f, g in zip([100, 90, 80, 70, 60, 50, 40, 30], groups) if g == k) for k in set(groups)]
    assert len(sums) == 2 and abs(sums[0] - sums[1]) <= 10


@pytest.mark.parametrize("tiered", [True, False])
def test_assign(spark, tiered):
    rows = [(f"d{i}", n) for i, n in enumerate([0, 5, 16, 17, 64, 65, 300, None, 1, 1, 1])] + [(None, 9), ("d1", 5), ("d1", 5)]
    items = spark.createDataFrame(rows, "doc_id string, n_tokens bigint").selectExpr("*", "1 as shard", "'x' as item_id")
    targets = spark.createDataFrame([("s", 16), ("l", 64), ("bad", 0)], "pack_name string, capacity_tokens bigint")
    out = packing.assign(items, targets, tiered=tiered, shard_items=4)
    got = out.groupBy("item_id").sum("n_tokens").collect()
    times = 1 if tiered else 2
    assert {r[0]: r[1] for r in got} == {f"d{i}": n * times for i, n in enumerate([0, 5, 16, 17, 64, 65, 300, 0, 1, 1, 1]) if n}
    assert out.groupBy("container_id", "capacity_tokens").sum("n_tokens").where("`sum(n_tokens)` > capacity_tokens").count() == 0
    if not tiered:
        assert {(r[0], r[1]) for r in out.groupBy("pack_name").sum("n_tokens").collect()} == {("s", 470), ("l", 470)}
    assert packing.report(out).count() == 2
    assert packing.assign(items.limit(0), targets).count() == 0
    assert packing.assign(items, targets.limit(0)).count() == 0


def test_first_query_packs_in_tiers(spark, monkeypatch):
    import bench

    name = next(n for n in entries.queries() if n.startswith("p6_"))
    assert name in bench.HEADLINE
    items = spark.createDataFrame([(f"d{i}", n) for i, n in enumerate([60, 3, 16, 5])], "doc_id string, n_tokens bigint")
    targets = spark.createDataFrame([("s", 16), ("l", 64)], "pack_name string, capacity_tokens bigint")
    monkeypatch.setattr(entries, "_sizes", lambda *_: items)
    monkeypatch.setattr(entries, "table", lambda *_: targets)
    out = entries.queries()[name](spark, "")
    assert out.count() == 4 and {r[0] for r in out.where("item_id in ('d0', 'd1')").select("container_id").collect()} == {"l-0-0"}
    assert entries.p6_tiers_report(spark, "").count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60))
def test_combine_keeps_every_part_in_one_container(sizes):
    made = packing.pack(sizes, [16, 64, 256])
    whole = packing.combine(made, 256)
    assert sorted(p for _, inside in whole for p in inside) == sorted(p for _, inside in made for p in inside)
    assert all(c == 256 and 0 < sum(p[3] for p in inside) <= 256 for c, inside in whole)


def test_every_capacity_is_packed_tightly_and_evenly():
    import random

    r = random.Random(2)
    sizes = [r.randint(20, 3000) for _ in range(3000)]
    for tiers in ([512], [512, 2048], [512, 2048, 8192]):
        whole = packing.combine(packing.pack(sizes, tiers), tiers[-1])
        fills = [sum(p[3] for p in inside) for _, inside in whole]
        assert sum(fills) == sum(sizes) and sum(fills) >= 0.99 * tiers[-1] * len(whole)
        groups = packing.step_groups(fills, 8)
        steps = [sum(f for f, g in zip(fills, groups) if g == k) / groups.count(k) for k in set(groups)]
        assert max(steps) - min(steps) <= tiers[-1] / 8  # one group holds the last container, which may be nearly empty


def test_too_many_targets_are_an_error(spark):
    items = spark.createDataFrame([("a", 1)], "doc_id string, n_tokens bigint")
    targets = spark.range(packing.MAX_TARGETS + 1).selectExpr("concat('t', id) as pack_name", "id + 1 as capacity_tokens")
    with pytest.raises(ValueError):
        packing.assign(items, targets)
