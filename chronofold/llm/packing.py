"""Filling fixed-capacity containers, by hierarchical multi-length packing.

Containers come in tiers of capacity. An item goes to the smallest tier that
holds it; an item beyond the largest capacity is cut into full containers and a
rest, which is an item again. Each tier is packed largest first, and whatever room
a longer container has left is filled with the largest items that fit, from its
own or any shorter tier. What would fill a shorter container badly is combined in
the longest containers instead. Containers of a tier are then dealt to step groups so
that the groups of a shard carry nearly equal numbers of tokens.

Only ids and sizes are shuffled, to shards of about SHARD_ITEMS items each, by a
hash; every shard has the length distribution of the whole, and leaves at most a
few containers short. Largest-that-fits is one lookup in a union-find over sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

SHARD_ITEMS = 25_000
MAX_TARGETS = 1_000
STEP_CONTAINERS = 8
#: A shorter container that would leave more than this share unused gives its items up to the longest tier.
WASTE = 0.02
SCHEMA = "pack_name string, capacity_tokens bigint, container_id string, step_group string, item_id string, part_no int, token_from bigint, n_tokens bigint, container_offset bigint"


class SizeIndex:
    """Items by size with the largest size at most s in nearly constant time."""

    def __init__(self, sizes: np.ndarray):
        top = int(sizes.max()) if len(sizes) else 0
        self.at: list[list[int]] = [[] for _ in range(top + 1)]
        for i in np.argsort(-np.arange(len(sizes)), kind="stable"):
            self.at[sizes[i]].append(int(i))
        self.down = [s if self.at[s] else s - 1 for s in range(top + 1)]
        self.down[0] = 0
        self.top = top

    def find(self, s: int) -> int:
        s = min(s, self.top)
        root = s
        while self.down[root] != root:
            root = self.down[root]
        while self.down[s] != root:
            self.down[s], s = root, self.down[s]
        return root

    def take(self, s: int) -> int | None:
        """An item of the largest size up to s."""
        s = self.find(s)
        if s == 0:
            return None
        i = self.at[s].pop()
        if not self.at[s]:
            self.down[s] = s - 1
        return i


def pack(sizes: list[int], capacities: list[int], waste: float = WASTE) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Containers as (capacity, [(item, part_no, token_from, size)]). Sizes of 0 need no place."""
    caps = sorted(set(capacities))
    top = caps[-1]
    out, parts, later = [], [], []
    for i, n in enumerate(sizes):
        full, rest = divmod(n, top) if n > top else (0, n)
        out += [(top, [(i, k, k * top, top)]) for k in range(full)]
        if rest:
            parts.append((i, full, full * top, rest))
    index = SizeIndex(np.array([p[3] for p in parts], np.int64))
    while (first := index.take(top)) is not None:
        size = parts[first][3]
        cap = next(c for c in caps if c >= size)
        inside, room = [parts[first]], cap - size
        while room and (more := index.take(room)) is not None:
            inside.append(parts[more])
            room -= parts[more][3]
        if cap < top and room > waste * cap:
            later += inside
        else:
            out.append((cap, inside))
    index = SizeIndex(np.array([p[3] for p in later], np.int64))
    while (first := index.take(top)) is not None:
        inside, room = [later[first]], top - later[first][3]
        while room and (more := index.take(room)) is not None:
            inside.append(later[more])
            room -= later[more][3]
        out.append((next(c for c in caps if c >= top - room), inside))
    return out


def combine(made: list[tuple[int, list[tuple[int, int, int, int]]]], capacity: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """The containers of all tiers, packed whole into containers of one capacity."""
    fills = [sum(p[3] for p in inside) for _, inside in made]
    index, out = SizeIndex(np.array(fills, np.int64)), []
    while (first := index.take(capacity)) is not None:
        inside, room = list(made[first][1]), capacity - fills[first]
        while room and (more := index.take(room)) is not None:
            inside += made[more][1]
            room -= fills[more]
        out.append((capacity, inside))
    return out


def step_groups(fills: list[int], per_step: int) -> list[int]:
    """A group for each container: fullest first, dealt back and forth."""
    groups = -(-len(fills) // per_step)
    out = [0] * len(fills)
    for n, i in enumerate(sorted(range(len(fills)), key=lambda i: (-fills[i], i))):
        turn, place = divmod(n, groups)
        out[i] = place if turn % 2 == 0 else groups - 1 - place
    return out


def assign(items: DataFrame, targets: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", tiered: bool = True, shard_items: int = SHARD_ITEMS, step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """SCHEMA: a row for each placed part of an item.

    tiered: the targets are tiers and each item is placed once; else every target
    gets a packing of all items of its own, through the tiers up to it, whose
    containers are then packed whole into its own. A null key or size and a size under
    1 are left out; a repeated key counts once, with its largest size. An empty table
    of items or targets gives an empty result; more than MAX_TARGETS targets are an
    error."""
    found = targets.where("capacity_tokens > 0 and pack_name is not null").select("pack_name", "capacity_tokens").distinct().limit(MAX_TARGETS + 1).collect()
    if len(found) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    tiers = sorted((r["capacity_tokens"], r["pack_name"]) for r in found)
    clean = items.select(F.col(key).cast("string").alias("item_id"), F.col(size).cast("long").alias("n")).where("item_id is not null and n > 0").groupBy("item_id").agg(F.max("n").alias("n"))
    clean = Scratch(items.sparkSession, "packing").save(clean)  # sizes are counted once
    shards = max(1, -(-clean.count() // shard_items))
    # Each way: the tiers to route by, and the target that takes all of them, if it is one.
    ways = [(tiers, None)] if tiered else [([x for x in tiers if x[0] <= t[0]], t) for t in tiers]

    def placed(shard: int, ids: list[str], sizes: list[int]) -> pd.DataFrame:
        rows = []
        for way, target in ways if tiers else []:
            made = pack(sizes, [c for c, _ in way])
            name = dict(reversed(way))
            if target:
                made, name = combine(made, target[0]), {target[0]: target[1]}
            for cap in sorted({c for c, _ in made}):
                own = [inside for c, inside in made if c == cap]
                groups = step_groups([sum(p[3] for p in inside) for inside in own], step_containers)
                for n, (inside, step) in enumerate(zip(own, groups)):
                    offset = 0
                    for i, part, start, length in inside:
                        rows.append((name[cap], cap, f"{name[cap]}-{shard}-{n}", f"{name[cap]}-{shard}-{step}", ids[i], part, start, length, offset))
                        offset += length
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition is one shard."""
        whole = [f for f in frames if len(f)]
        if whole:
            pdf = pd.concat(whole).sort_values("item_id")
            yield placed(int(pdf["shard"].iloc[0]), pdf["item_id"].tolist(), pdf["n"].tolist())

    return clean.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard")).mapInPandas(run, SCHEMA)


def report(assigned: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, unused share, and the spread of tokens over step groups."""
    steps = assigned.groupBy("pack_name", "capacity_tokens", "step_group").agg(F.count_distinct("container_id").alias("c"), F.sum("n_tokens").alias("t"))
    out = steps.groupBy("pack_name", "capacity_tokens").agg(F.sum("c").alias("n_containers"), F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_step_groups"), (F.stddev_pop(F.col("t") / F.col("c")) / F.first("capacity_tokens")).alias("step_spread"))
    return out.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
