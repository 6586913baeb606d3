"""Parent-child links to full hierarchies, by heavy-path decomposition.

A row names its parent; trees have unknown depth and some links run in circles.
The work is done in rounds of joins that double the distance they look up, so a
chain of a million rows takes twenty rounds and no tree is ever gathered in one
task:

1. Doubling ancestors with subtree sizes, over the rows that have an ancestor that far
   up and no others: each adds the rows known below it to its ancestor.
2. Cycle separation: when no row drops out of a round any more, what is left leads to
   cycles; their d-th ancestors are exactly the cycle rows once the parent map is
   one-to-one on them. The smallest id of a cycle is found by doubling too.
3. Each parent's largest child continues its chain. Doubling along chains labels
   every row with its chain's head and its place in the chain.
4. Chains form a tree of at most log2(n) levels. Its doubling concatenates chain
   segments (the path; their lengths are the depth, the first chain's head is the
   root) and adds offsets (the preorder number, so that the descendants of v are
   the rows of its root numbered from pre + 1 to pre + size - 1).

Rounds are written to the shared folder; a round reads and writes the rows that still
climb, and looks the others up. Hubs: sizes are summed on the map side, the lookup
join is the last step before the write, so the adaptive skew join can split it, and
the order of a hub's children is summed in buckets.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch

CHILDREN_PER_TASK = 50_000
SEGMENT = "array<struct<chain:string,rows:bigint>>"


@dataclass
class Hierarchy:
    """nodes: group_id, node_id, parent_id, root_id, depth, subtree_size, chain_id,
    chain_pos, preorder, segments (chains above, each with the number of its rows
    on the path, ending with the node's own chain); rows that lead to a cycle have
    depth -1, root_id = smallest id of the cycle, on_cycle, and nulls elsewhere."""

    nodes: DataFrame
    linked_only: bool

    def paths(self, separator: str = "/") -> DataFrame:
        """(group_id, node_id, path) for rows off cycles. The output is as long as
        the sum of the depths; each path is put together from chain rows."""
        tree = self.nodes.where(F.col("depth") >= 0)
        want = tree.select("group_id", "node_id", F.posexplode("segments").alias("no_", "seg_")).select("group_id", "node_id", "no_", F.col("seg_.chain").alias("chain_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seg_.rows") - 1)).alias("chain_pos"))
        rows = tree.select("group_id", "chain_id", "chain_pos", F.col("node_id").alias("step_"))
        steps = want.join(rows, ["group_id", "chain_id", "chain_pos"])
        path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no_", "chain_pos", "step_"))), lambda x: x["step_"]), separator)
        return steps.groupBy("group_id", "node_id").agg(path.alias("path"))

    def intervals(self) -> DataFrame:
        """(group_id, node_id, root_id, place, last_place) for rows off cycles: the
        descendants of a row are the rows of its root with a place after its own, up to
        its last. Of a row's children the largest (of equals the one of
        largest id) comes first, then the others by id, beyond CHILDREN_PER_TASK in buckets."""
        tree = self.nodes.where(F.col("depth") >= 0)
        return tree.select("group_id", "node_id", "root_id", F.col("preorder").alias("place"), (F.col("preorder") + F.col("subtree_size") - 1).alias("last_place"))

    def descendants(self) -> DataFrame:
        """(group_id, root_id, ancestor_id, descendant_id): a row for each pair, found
        chain by chain: a row is above all rows of later places on the chains of its
        descendants' segments."""
        tree = self.nodes.where(F.col("depth") >= 0)
        below = tree.select("group_id", "root_id", F.col("node_id").alias("descendant_id"), F.explode("segments").alias("seg_")).select("group_id", "root_id", "descendant_id", F.col("seg_.chain").alias("chain_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("seg_.rows") - 1)).alias("chain_pos"))
        above = tree.select("group_id", "chain_id", "chain_pos", F.col("node_id").alias("ancestor_id"))
        return below.join(above, ["group_id", "chain_id", "chain_pos"]).where(F.col("ancestor_id") != F.col("descendant_id")).select("group_id", "root_id", "ancestor_id", "descendant_id")


def build(df: DataFrame, node: str, parent: str, group: str, linked_only: bool = False) -> Hierarchy:
    """Hierarchy of the rows of df; ids are unique within a group.

    A null node or group is left out. A parent that does not exist in the group
    (an empty string included) makes the row a root. Repeated rows count once;
    if they disagree, the smallest parent holds. An empty table gives an empty
    result. linked_only leaves out rows that neither name nor are a parent."""
    tmp = Scratch(df.sparkSession, "hierarchy")
    every = df.select(F.col(group).cast("string").alias("g"), F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("up")).dropna(subset=["g", "id"])
    named = tmp.save(every.groupBy("g", "id").agg(F.min("up").alias("up")))
    there = named.select("g", F.col("id").alias("up"), F.lit(True).alias("there"))
    linked = named.where(F.col("up").isNotNull()).join(there, ["g", "up"], "left").select("g", "id", F.when(F.col("there"), F.col("up")).alias("up"))
    linked = tmp.save(linked)
    bare = named.where(F.col("up").isNull())
    if linked_only:
        bare = bare.join(linked.where(F.col("up").isNotNull()).select("g", F.col("up").alias("id")).distinct(), ["g", "id"], "left_semi")
    links = tmp.save(linked.unionByName(bare))

    added, stray = _double(links, tmp)
    tree = links if stray is None else links.join(stray.select("g", "id"), ["g", "id"], "left_anti")
    tree = tree.join(added, ["g", "id"], "left").select("g", "id", "up", (F.lit(1) + F.coalesce("add", F.lit(0))).cast("long").alias("size"))
    with ThreadPoolExecutor(1) as beside:  # trees and cycles have no row in common
        loops = beside.submit(_cycles, stray, links, Scratch(df.sparkSession, "cycles")) if stray is not None else None
        out = _chain_tree(_chains(tmp.save(tree), tmp), tmp)
        if loops is not None:
            out = out.unionByName(loops.result(), allowMissingColumns=True)
    return Hierarchy(out, linked_only)


def _double(links: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(g, id, add: rows below it in its tree) and the rows that lead to cycles with an
    ancestor on them (g, id, anc), None if there are none."""
    climbing = links.where(F.col("up").isNotNull()).select("g", "id", F.col("up").alias("anc"), F.lit(1).cast("long").alias("size"))
    left, adds, kept = climbing.count(), [], []
    while left:
        add = climbing.groupBy("g", F.col("anc").alias("id")).agg(F.sum("size").alias("add"))
        look = climbing.select("g", F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        grown = climbing.join(add, ["g", "id"], "left").join(look, ["g", "anc"])
        new = tmp.save(grown.select("g", "id", F.col("anc2").alias("anc"), (F.col("size") + F.coalesce("add", F.lit(0))).alias("size")))
        adds.append(climbing.select("g", F.col("anc").alias("id"), F.col("size").alias("add")))
        before, left, climbing = left, new.count(), new
        if left and left == before:
            while not _only_cycles(climbing, links):
                look = climbing.select("g", F.col("id").alias("anc"), F.col("anc").alias("anc2"))
                climbing = tmp.save(climbing.join(look, ["g", "anc"]).select("g", "id", F.col("anc2").alias("anc")))
            kept = [climbing]
            break
    none = links.limit(0).select("g", "id", F.lit(0).cast("long").alias("add"))
    return reduce(DataFrame.unionByName, adds, none).groupBy("g", "id").agg(F.sum("add").alias("add")), kept[0] if kept else None


def _reached(stray: DataFrame) -> DataFrame:
    return stray.select("g", F.col("anc").alias("id")).distinct()


def _only_cycles(stray: DataFrame, links: DataFrame) -> bool:
    """Whether the rows reached are cycle rows and no others: the parent map is one-to-one on them."""
    r = _reached(stray).join(links, ["g", "id"]).groupBy("g", "up").count().agg(F.max("count").alias("most")).first()
    return r["most"] == 1


def _cycles(stray: DataFrame, links: DataFrame, tmp: Scratch) -> DataFrame:
    ring = tmp.save(_reached(stray).join(links, ["g", "id"]).select("g", "id", F.col("up").alias("jump"), F.col("id").alias("low")))
    while True:
        look = ring.select("g", F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        new = tmp.save(ring.join(look, ["g", "jump"]).select("g", "id", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        old, ring = ring, new
        if not ring.where("moved").limit(1).count():
            break
        tmp.drop(old)
    low = ring.select("g", F.col("id").alias("anc"), "low")
    on = ring.select("g", "id", F.lit(True).alias("on_cycle"))
    rows = stray.select("g", "id", "anc").join(low, ["g", "anc"]).join(on, ["g", "id"], "left").join(links, ["g", "id"])
    return rows.select(F.col("g").alias("group_id"), F.col("id").alias("node_id"), F.col("up").alias("parent_id"), F.col("low").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _chains(tree: DataFrame, tmp: Scratch) -> DataFrame:
    """tree: g, id, up, size. Adds head, pos (place in the chain) and, for heads,
    skip (rows between the parent and the head in preorder)."""
    kids = tree.where(F.col("up").isNotNull())
    heavy = kids.groupBy("g", "up").agg(F.max(F.struct("size", "id")).alias("h"), F.count(F.lit(1)).alias("n")).select("g", "up", F.col("h.id").alias("heavy"), F.col("h.size").alias("heavy_size"), F.col("n"))
    kids = tmp.save(kids.join(heavy, ["g", "up"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHILDREN_PER_TASK)).cast("int")))
    light = kids.where(F.col("id") != F.col("heavy"))
    inside = Window.partitionBy("g", "up", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("g", "up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    light_in = light.select("g", "up", "id", "bucket", "heavy_size", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("left_"))
    buckets = light.groupBy("g", "up", "bucket").agg(F.sum("size").alias("s")).select("g", "up", "bucket", F.coalesce(F.sum("s").over(across), F.lit(0)).alias("base_"))
    skips = light_in.join(buckets, ["g", "up", "bucket"]).select("g", "id", (F.lit(1) + F.col("heavy_size") + F.col("left_") + F.col("base_")).alias("skip"))
    on = kids.where(F.col("id") == F.col("heavy")).select("g", "id", F.col("up").alias("to"))
    state = tree.join(on, ["g", "id"], "left").join(skips, ["g", "id"], "left").select("g", "id", "up", "size", F.coalesce("to", "id").alias("head"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.coalesce("skip", F.lit(0)).cast("long").alias("skip"))
    parts, step = [tmp.save(state)], 1
    climbing = parts[0].where(F.col("pos") == 1)
    parts[0] = parts[0].where(F.col("pos") == 0)
    while climbing.limit(1).count():
        look = reduce(DataFrame.unionByName, parts, climbing).select("g", F.col("id").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"))
        new = tmp.save(climbing.join(look, ["g", "head"]).select("g", "id", "up", "size", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), "skip"))
        step *= 2
        climbing, done = new.where(F.col("pos") == step), new.where(F.col("pos") < step)
        parts.append(done)
    return reduce(DataFrame.unionByName, parts)


def _chain_tree(nodes: DataFrame, tmp: Scratch) -> DataFrame:
    """Doubling over chains: concatenates segments and adds offsets."""
    heads = nodes.where(F.col("head") == F.col("id")).select("g", "id", "up", "skip")
    place = nodes.select("g", F.col("id").alias("up"), F.col("head").alias("above"), F.col("pos").alias("at"))
    seg = F.when(F.col("above").isNull(), F.array().cast(SEGMENT)).otherwise(F.array(F.struct(F.col("above").alias("chain"), (F.col("at") + 1).alias("rows"))).cast(SEGMENT))
    chain = heads.join(place, ["g", "up"], "left").select("g", "id", "above", seg.alias("segs"), F.when(F.col("above").isNull(), 0).otherwise(F.col("at") + F.col("skip")).cast("long").alias("off"))
    chain = tmp.save(chain)
    parts, climbing = [chain.where(F.col("above").isNull())], chain.where(F.col("above").isNotNull())
    while climbing.limit(1).count():
        look = reduce(DataFrame.unionByName, parts, climbing).select("g", F.col("id").alias("above"), F.col("above").alias("above2"), F.col("segs").alias("segs2"), F.col("off").alias("off2"))
        new = tmp.save(climbing.join(look, ["g", "above"]).select("g", "id", F.col("above2").alias("above"), F.concat("segs2", "segs").alias("segs"), (F.col("off") + F.col("off2")).alias("off")))
        parts.append(new.where(F.col("above").isNull()))
        climbing = new.where(F.col("above").isNotNull())
    up = reduce(DataFrame.unionByName, parts).select("g", F.col("id").alias("head"), "segs", "off")
    whole = nodes.join(up, ["g", "head"]).withColumn("segs", F.concat("segs", F.array(F.struct(F.col("head").alias("chain"), (F.col("pos") + 1).alias("rows"))).cast(SEGMENT)))
    return whole.select(
        F.col("g").alias("group_id"), F.col("id").alias("node_id"), F.col("up").alias("parent_id"), F.element_at("segs", 1)["chain"].alias("root_id"), (F.aggregate("segs", F.lit(0).cast("long"), lambda a, x: a + x["rows"]) - 1).alias("depth"),
        F.col("size").alias("subtree_size"), F.col("head").alias("chain_id"), F.col("pos").alias("chain_pos"), (F.col("off") + F.col("pos")).alias("preorder"), F.col("segs").alias("segments"), F.lit(False).alias("on_cycle"),
    )


def supersession(assertions: DataFrame, linked_only: bool = True) -> Hierarchy:
    """Problem 3: assertions by the assertion they replace, per tenant."""
    return build(assertions, "assertion_id", "supersedes_assertion_id", "tenant_id", linked_only)
