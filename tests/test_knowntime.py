import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.operators import knowntime
from chronofold.operators.common import FOREVER

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
FACTS = "tenant_id string, subject_entity_id string, predicate string, assertion_id string, valid_from timestamp, valid_to timestamp, system_from timestamp, system_to timestamp, event_id string, extra_ int"
EVENTS = "event_id string, tenant_id string, subject_entity_id string, predicate string, known_time timestamp, valid_time timestamp, valid_from timestamp"


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_persistent_tree_equals_scan(rows):
    facts = [(f"f{i}", a, z, s, e if e else FOREVER) for i, (a, z, s, e) in enumerate(rows)]
    tree = knowntime.PersistentIntervals(facts)
    for known in range(0, 32, 3):
        for valid in range(0, 32, 3):
            want = {i for i, a, z, s, e in facts if a <= valid < z and s <= known < e}
            got = list(tree.at(known, valid))
            assert set(got) == want and len(got) == len(want)


def _data(spark, n_facts, n_events, seed):
    r = random.Random(seed)
    key = lambda: ("t", r.choice("aab"), "p")
    facts, events = [], []
    for i in range(n_facts):
        a, s = r.randint(0, 50), r.randint(0, 50)
        facts.append((*key(), f"f{i}", at(a), at(r.choice([None, a + r.randint(-2, 20)])), at(s), at(r.choice([None, s + r.randint(1, 20)])), "x", 1))
    facts += facts[:5]
    for i in range(n_events):
        events.append((f"e{i}", *key(), at(r.randint(0, 60)), at(r.randint(0, 60)), None))
    events += events[:3]
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS), facts, events


def _brute(facts, events, both):
    out = set()
    for e in events:
        for f in facts:
            known, valid = e[4], e[5] if both else e[4]
            if f[:3] == e[1:4] and f[4] <= valid and (f[5] is None or valid < f[5]) and f[6] <= known and (f[7] is None or known < f[7]):
                out.add((e[0], f[3]))
    return out


@pytest.mark.parametrize("both", [False, True])
@pytest.mark.parametrize("caps", [(50_000, 200_000), (7, 5)])
def test_known_at_equals_brute_force_also_with_split_hot_keys(spark, both, caps):
    f, e, facts, events = _data(spark, 60, 40, 3)
    got = [tuple(r) for r in knowntime.known_at(e, f, valid_time="valid_time" if both else None, facts_per_task=caps[0], events_per_task=caps[1]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(facts, events, both)


def test_nulls_and_empty_tables(spark):
    f = spark.createDataFrame([("t", "a", "p", "f", None, None, at(0), None, "x", 1), (None, "a", "p", "g", at(0), None, at(0), None, "x", 1), ("t", "a", "p", None, at(0), None, at(0), None, "x", 1), ("t", "a", "p", "ok", at(0), None, at(0), None, "x", 1)], FACTS)
    e = spark.createDataFrame([("e", "t", "a", "p", at(5), at(5), None), (None, "t", "a", "p", at(5), at(5), None), ("n", "t", "a", "p", None, at(5), None)], EVENTS)
    assert [tuple(r) for r in knowntime.known_at(e, f).collect()] == [("e", "ok")]
    assert knowntime.known_at(e.limit(0), f).count() == 0
    assert knowntime.known_at(e, f.limit(0)).count() == 0


def test_bounds_are_half_open(spark):
    f = spark.createDataFrame([("t", "a", "p", "f", at(1), at(2), at(1), at(2), "x", 1)], FACTS)
    e = spark.createDataFrame([(f"e{h}", "t", "a", "p", at(h), at(h), None) for h in (0, 1, 2)], EVENTS)
    assert [r[0] for r in knowntime.known_at(e, f).collect()] == ["e1"]


def test_named_in_request(spark):
    rows = [
        ('{"subjectEntityId":"s","predicate":"p"}', "s", "p"),
        ('{"context":{"subjectEntityId":"s","predicate":"p"}}', "s", "p"),
        ('{"predicate":null,"context":{"subjectEntityId":"s","predicate":"p"}}', "s", "p"),
        ('{"items":[{"subjectEntityId":"no"}],"subjectEntityId":"s"}', "s", None),
        ('{"other":{"context":{"subjectEntityId":"no"}}}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "request_json string, s string, p string")
    s, p = knowntime.named_in_request()
    assert df.select(s.eqNullSafe(F.col("s")) & p.eqNullSafe(F.col("p"))).distinct().collect() == [(True,)]


def test_a_hot_key_on_both_sides_is_not_multiplied(spark, monkeypatch):
    n, hours = 2000, 5000
    r = random.Random(4)
    facts = [("t", "a", "p", f"f{i}", at(h), at(h + r.randint(1, 4)), at(h), None, "x", 1) for i, h in enumerate(r.randrange(hours) for _ in range(n))]
    events = [(f"e{i}", "t", "a", "p", at(r.randrange(hours)), None, None) for i in range(n)]
    seen = []
    whole = knowntime._together

    def counted(*a):
        both, group = whole(*a)
        seen.append((both.count(), both.groupBy(*group).count().agg(F.max("count")).first()[0]))
        return both, group

    monkeypatch.setattr(knowntime, "_together", counted)
    f, e = spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS)
    got = [tuple(x) for x in knowntime.known_at(e, f, facts_per_task=50, events_per_task=50).collect()]
    assert set(got) == _brute(facts, events, False) and len(got) == len(set(got))
    rows, largest = seen[0]
    assert rows < 3 * 2 * n and largest < 4 * 50  # by hash on both sides it was 2 * n * n / 50 = 160,000


def test_many_events_at_one_time_are_split(spark):
    facts = [("t", "a", "p", f"f{i}", at(i % 3), None, at(0), None, "x", 1) for i in range(30)]
    events = [(f"e{i}", "t", "a", "p", at(2), None, None) for i in range(200)] + [(f"l{i}", "t", "a", "p", at(i), None, None) for i in range(40)]
    f, e = spark.createDataFrame(facts, FACTS), spark.createDataFrame(events, EVENTS)
    got = [tuple(x) for x in knowntime.known_at(e, f, facts_per_task=10, events_per_task=20).collect()]
    assert set(got) == _brute(facts, events, False) and len(got) == len(set(got))
