"""Attributes as known at event time.

Facts carry a valid interval and a recorded (system) interval. For every event
all facts of its key come out that were valid at the event's valid time and
recorded at its known time. Per shard of a key a persistent search tree is
built by path copying: one root per recorded time, leaves in order of
valid_from, every inner node holding the largest valid_to below it. An event
picks its root by known time and then searches the valid-time key.

Work is O((facts + events) log facts + matches). Events of a hot key are cut into
slabs at quantiles of their time. With one time for both axes a fact goes to the slabs
that it meets: to two in part, and to those between in whole, where it matches every
event, so that copies of facts are bounded by facts and matches. Facts of a slab beyond
a task's share are split by a hash of their id, and the slab's events, no more than a
task's share, go to each part. So no hot key has its facts and events multiplied, and
events stream past the tree and are never collected.

With a valid time apart from the known time, slabs are cut by known time, and a fact
that stays recorded goes to all later slabs of its key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOREVER, bisect, hot_splits, quantile_cuts, us, visible, with_splits

_NEVER = -(2**63)


class PersistentIntervals:
    """All versions of a set of valid intervals, by recorded time."""

    def __init__(self, rows: list[tuple[str, int, int, int, int]]):
        """rows: (id, valid_from, valid_to, system_from, system_to)."""
        rows = sorted(set(rows), key=lambda r: (r[1], r[0]))
        self.ids = [r[0] for r in rows]
        self.starts = [r[1] for r in rows]
        self.height = max(0, (len(rows) - 1).bit_length())
        self._left, self._right, self._top = [0], [0], [_NEVER]
        changes = []
        for i, r in enumerate(rows):
            if r[2] > r[1] and r[4] > r[3]:
                changes.append((r[3], i, r[2]))
                if r[4] != FOREVER:
                    changes.append((r[4], i, _NEVER))
        changes.sort()
        self.times: list[int] = []
        self.roots: list[int] = []
        root = 0
        for at, i, end in changes:
            root = self._copy_path(root, i, end)
            if self.times and self.times[-1] == at:
                self.roots[-1] = root
            else:
                self.times.append(at)
                self.roots.append(root)

    def _copy_path(self, node: int, leaf: int, end: int) -> int:
        left, right, top = self._left, self._right, self._top
        path = []
        for bit in range(self.height - 1, -1, -1):
            path.append(node)
            node = right[node] if leaf >> bit & 1 else left[node]
        new = 0
        if end != _NEVER:
            new = len(top)
            left.append(0), right.append(0), top.append(end)
        for bit in range(self.height):
            old = path.pop()
            a, b = (left[old], new) if leaf >> bit & 1 else (new, right[old])
            if a == b == 0:
                new = 0
                continue
            new = len(top)
            left.append(a), right.append(b), top.append(max(top[a], top[b]))
        return new

    def at(self, known: int, valid: int) -> Iterator[str]:
        version = bisect_right(self.times, known) - 1
        if version < 0:
            return
        before = bisect_right(self.starts, valid)
        left, right, top = self._left, self._right, self._top
        todo = [(self.roots[version], self.height, 0)]
        while todo:
            node, height, base = todo.pop()
            if base >= before or top[node] <= valid:
                continue
            if height == 0:
                yield self.ids[base]
            else:
                todo.append((left[node], height - 1, base))
                todo.append((right[node], height - 1, base + (1 << height - 1)))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, facts, tree, last = None, [], None, None
    events, found = [], []
    for b in batches:
        for k1, k2, k3, slab, part, split, is_event, rid, a, z, sa, sz in zip(*(c.to_pylist() for c in b.columns)):
            if key != (k1, k2, k3, slab, part, split):
                key, facts, tree, last = (k1, k2, k3, slab, part, split), [], None, None
            if not is_event:
                facts.append((rid, a, z, sa, sz))
                continue
            if not facts or last == (rid, sa, a):  # a redelivered event follows its first copy
                continue
            last = (rid, sa, a)
            if tree is None:
                tree = PersistentIntervals(facts)
            for x in tree.at(sa, a):
                events.append(rid)
                found.append(x)
        if len(events) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(events), pa.array(found)], names=["event_id", "fact_id"])
            events, found = [], []
    if events:
        yield pa.RecordBatch.from_arrays([pa.array(events), pa.array(found)], names=["event_id", "fact_id"])


def _together(f: DataFrame, e: DataFrame, k: list[str], one: bool, facts_per_task: int, events_per_task: int) -> tuple[DataFrame, list[str]]:
    """Facts and events side by side, and the columns of the groups that meet in a task."""
    cuts, most = quantile_cuts(e, k, "sa_", events_per_task, "cuts_")
    if cuts is None:
        f, e = f.withColumn("slab_", F.lit(0)), e.withColumn("slab_", F.lit(0))
    else:
        slab = lambda t: F.coalesce(bisect("cuts_", t, most), F.lit(0))
        from_, to = (F.greatest("a_", "sa_"), F.least("z_", "sz_")) if one else (F.col("sa_"), F.col("sz_"))
        f = f.join(cuts, k, "left").withColumn("slab_", F.explode(F.sequence(slab(from_), slab(to - 1)))).drop("cuts_")
        e = e.join(cuts, k, "left").withColumn("slab_", slab(F.col("sa_"))).drop("cuts_")
    at = [*k, "slab_"]
    hot_f = hot_splits(f, at, facts_per_task, "parts_")
    hot_e = hot_splits(e, at, 2 * events_per_task, "splits_") if cuts is not None else None  # many events at one time

    def spread(df: DataFrame) -> DataFrame:
        return with_splits(with_splits(df, hot_f, at, "parts_"), hot_e, at, "splits_")

    share = lambda n: F.pmod(F.xxhash64("id_"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = [*at, "part_", "split_"]
    cols = [*group, "is_event_", "id_", "a_", "z_", "sa_", "sz_"]
    f = spread(f).withColumn("part_", share("parts_")).withColumn("split_", every("splits_") if hot_e is not None else F.lit(0))
    e = spread(e).withColumn("part_", every("parts_") if hot_f is not None else F.lit(0)).withColumn("split_", share("splits_"))
    both = f.withColumn("is_event_", F.lit(False)).select(cols).unionByName(e.withColumns({"is_event_": F.lit(True), "z_": F.lit(0).cast("long"), "sz_": F.lit(0).cast("long")}).select(cols))
    return both, group


def known_at(
    events: DataFrame,
    facts: DataFrame,
    *,
    event_id: str = "event_id",
    event_keys: tuple[str, str, str] = ("tenant_id", "subject_entity_id", "predicate"),
    known_time: str = "known_time",
    valid_time: str | None = None,
    fact_id: str = "assertion_id",
    fact_keys: tuple[str, str, str] = ("tenant_id", "subject_entity_id", "predicate"),
    facts_per_task: int = 50_000,
    events_per_task: int = 100_000,
) -> DataFrame:
    """(event_id, fact_id): distinct pairs where the fact has the event's keys,
    valid_from <= valid time < valid_to and system_from <= known time < system_to.

    A null valid_to or system_to is open; a null start, id, key or event time
    matches nothing; an interval that is not positive matches nothing. Repeated
    rows count once; an event id with several times is searched at each. Tables may be
    empty and may have any further columns; only the named ones are read."""
    one = valid_time is None
    k = ["k1_", "k2_", "k3_"]
    end = lambda c: F.coalesce(us(c), F.lit(FOREVER))
    f = facts.select(*(F.col(c).alias(n) for c, n in zip(fact_keys, k)), F.col(fact_id).cast("string").alias("id_"), us("valid_from").alias("a_"), end("valid_to").alias("z_"), us("system_from").alias("sa_"), end("system_to").alias("sz_"))
    f = f.dropna(subset=[*k, "id_", "a_", "sa_"]).where((F.col("a_") < F.col("z_")) & (F.col("sa_") < F.col("sz_")))
    if one:  # both axes are searched at one instant, so the intervals must meet
        f = f.where(F.greatest("a_", "sa_") < F.least("z_", "sz_"))
    e = events.select(*(F.col(c).alias(n) for c, n in zip(event_keys, k)), F.col(event_id).cast("string").alias("id_"), us(valid_time or known_time).alias("a_"), us(known_time).alias("sa_")).dropna()
    both, group = _together(f, e, k, one, facts_per_task, events_per_task)
    return both.repartition(*group).sortWithinPartitions(*group, "is_event_", "id_", "sa_", "a_").mapInArrow(_search, "event_id string, fact_id string")


def named_in_request(request: Column | str = "request_json") -> tuple[Column, Column]:
    """The entity and attribute a request names: at the top level, else inside
    the top-level object context."""
    request = F.col(request) if isinstance(request, str) else request
    get = lambda name: F.coalesce(F.get_json_object(request, f"$.{name}"), F.get_json_object(request, f"$.context.{name}"))
    return get("subjectEntityId"), get("predicate")


def effects_with_known_assertions(effects: DataFrame, assertions: DataFrame) -> DataFrame:
    """Problem 1: (effect_id, assertion_id), see known_at."""
    subject, predicate = named_in_request()
    events = effects.select("tenant_id", "effect_id", subject.alias("subject_entity_id"), predicate.alias("predicate"), "created_at")
    return known_at(events, assertions.where(visible()), event_id="effect_id", known_time="created_at").select(F.col("event_id").alias("effect_id"), F.col("fact_id").alias("assertion_id"))
