"""Most similar vectors for every vector, by a forest of random-projection trees.

1. Parse: usable vectors are kept in a compact lossless form and written once.
2. Coarse trees: per group with more than SHARD_ROWS vectors a random-projection
   tree, fitted on a bounded sample (see FIT_ROWS) of all groups together, so
   that each leaf (a shard) holds about SHARD_ROWS of the rows. Every row is
   indexed in its home shard and searches, besides it, the shards that the
   priority queue over its margins names next.
3. In a shard a forest of random-projection trees over the home rows. A query
   has one priority queue for all trees: it takes the leaf behind the smallest
   margin next, whichever tree it is in, until PROBES leaves are taken. The
   candidates of all leaves are compared exactly, in 64-bit arithmetic.
4. The best k of all shards per query.

Vectors move once to the home and to the probed shards; the forest is built and
searched where they meet. Of more than k + 1 equal vectors of a group the k + 1
smallest ids are indexed; the others link to the k smallest, at similarity 1,
which is exact.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch

#: Rows of the sample: at least FIT_ROWS, four a shard, at most MAX_FIT_ROWS.
FIT_ROWS = 40_000
MAX_FIT_ROWS = 2_000_000
SHARD_ROWS = 40_000
#: Shards a row searches at most: this many, or as many as its tree has levels.
SHARD_PROBES = 4
#: A neighbouring shard is probed if the query lies so near the border (unit vectors).
SHARD_MARGIN = 0.09
TREES = 6
LEAF_ROWS = 64
PROBES = 18
#: Settings that also find neighbours without structure (cosines near 0.5 in 64 dimensions): few
#: large leaves, most of them compared, and shards by nearness of the border alone.
FAR = {"trees": 1, "leaf_rows": 2_500, "probes": 12, "shard_margin": np.inf}
MAX_GROUPS_ON_DRIVER = 100_000
_SCALE = 1e4


def encode(x: np.ndarray) -> list[bytes]:
    """Vectors whose numbers have at most four decimals take two bytes a number,
    others eight; both are exact."""
    with np.errstate(invalid="ignore", over="ignore"):
        r = np.rint(x * _SCALE)
    short = ((np.abs(r) <= 32767) & (r / _SCALE == x)).all(axis=1)
    return [a.astype("<i2").tobytes() if s else b.astype("<f8").tobytes() for a, b, s in zip(r, x, short)]


def decode(raw: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(raw), dims))
    short = np.array([len(b) == 2 * dims for b in raw], bool)
    if short.any():
        out[short] = np.frombuffer(b"".join(b for b, s in zip(raw, short) if s), "<i2").reshape(-1, dims) / _SCALE
    if not short.all():
        out[~short] = np.frombuffer(b"".join(b for b, s in zip(raw, short) if not s), "<f8").reshape(-1, dims)
    return out


def usable(text: str | None, dims: int) -> list[float] | None:
    """The numbers, if text is a JSON array of exactly dims finite numbers, not all zero."""
    if not text:
        return None
    try:
        v = json.loads(text)
        if type(v) is not list or len(v) != dims or not set(map(type, v)) <= {int, float}:
            return None
        v = [float(x) for x in v]
    except (ValueError, OverflowError, RecursionError):
        return None
    return v if any(v) and all(-1.8e308 < x < 1.8e308 for x in v) else None


def parse(df: DataFrame, dims: int) -> DataFrame:
    """df: g, id, text. Gives g, id, vec (see encode) for usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [usable(t, dims) for t in b.column("text").to_pylist()]
            keep = [i for i, v in enumerate(got) if v is not None]
            if keep:
                raw = encode(np.array([got[i] for i in keep]))
                yield pa.RecordBatch.from_arrays([b.column("g").take(pa.array(keep)), b.column("id").take(pa.array(keep)), pa.array(raw, pa.binary())], names=["g", "id", "vec"])

    return df.where("g is not null and id is not null and text is not null").mapInArrow(run, "g string, id string, vec binary")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(dims: int, n: int, seed: int) -> np.ndarray:
    """n random unit vectors (dims, n), orthogonal within each run of dims."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-n // dims))], axis=1)[:, :n].astype(np.float32)


class Forest:
    """Random-projection trees over projections p (rows, directions): each node
    splits at the median of one random direction. Leaves are numbered over all trees."""

    def __init__(self, p: np.ndarray, trees: int, leaf_rows: float, seed: int):
        rng = np.random.default_rng(seed)
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.leaf: list[int] = []
        self.members: list[np.ndarray] = []
        self.roots = []
        self.depth = 0
        for _ in range(trees):
            self.roots.append(self._new())
            todo = [(self.roots[-1], np.arange(len(p)), 0)]
            while todo:
                node, rows, depth = todo.pop()
                self.depth = max(self.depth, depth)
                if len(rows) > leaf_rows:
                    for axis in rng.permutation(p.shape[1])[:4]:
                        v = p[rows, axis]
                        cut = np.median(v)
                        right = v > cut
                        if 0 < right.sum() < len(rows):
                            break
                    else:  # copies of one vector beyond what was taken out before: split evenly
                        right = np.arange(len(rows)) % 2 == 1
                    a, b = self._new(), self._new()
                    self.axis[node], self.cut[node], self.kids[node] = int(axis), float(cut), (a, b)
                    todo += [(a, rows[~right], depth + 1), (b, rows[right], depth + 1)]
                else:
                    self.leaf[node] = len(self.members)
                    self.members.append(rows)
        self.axis_, self.cut_, self.kids_, self.leaf_ = np.array(self.axis), np.array(self.cut, np.float32), np.array(self.kids), np.array(self.leaf)

    def _new(self) -> int:
        self.axis.append(0), self.cut.append(0.0), self.kids.append((0, 0)), self.leaf.append(-1)
        return len(self.axis) - 1

    def search(self, p: np.ndarray, probes: int, margin: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(row of p, leaf): for each row the home leaf of every tree, then the leaves
        behind the smallest margins in any tree, up to probes leaves in all and while
        the margin is below the given one. All rows pop their queues in step."""
        n, trees = len(p), len(self.roots)
        width = trees * self.depth + max(0, probes - trees) * self.depth
        waiting = np.full((n, max(1, width)), np.inf, np.float32)
        nodes = np.zeros((n, max(1, width)), np.int32)
        used = np.zeros(n, np.int32)
        who, where = [], []

        def descend(rows: np.ndarray, node: np.ndarray, floor: np.ndarray) -> None:
            while len(rows):
                at = self.leaf_[node]
                done = at >= 0
                if done.any():
                    who.append(rows[done])
                    where.append(at[done])
                    rows, node, floor = rows[~done], node[~done], floor[~done]
                    if not len(rows):
                        return
                m = p[rows, self.axis_[node]] - self.cut_[node]
                right = m > 0
                kids = self.kids_[node]
                slot = used[rows]
                waiting[rows, slot] = np.maximum(floor, np.abs(m))
                nodes[rows, slot] = kids[np.arange(len(rows)), np.where(right, 0, 1)]
                used[rows] += 1
                node = kids[np.arange(len(rows)), right.astype(np.int8)]

        every = np.arange(n)
        for r in self.roots:
            descend(every, np.full(n, r), np.zeros(n, np.float32))
        for _ in range(probes - trees):
            best = waiting.argmin(axis=1)
            gap = waiting[every, best]
            rows = np.flatnonzero((gap < margin) & np.isfinite(gap))
            if not len(rows):
                break
            waiting[rows, best[rows]] = np.inf
            descend(rows, nodes[rows, best[rows]].astype(np.int64), gap[rows])
        return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, int), np.zeros(0, int))


def exact_top(forest: Forest, home: np.ndarray, home32: np.ndarray, queries: np.ndarray, queries32: np.ndarray, proj: np.ndarray, k: int, probes: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, home row, cosine) of the candidates that may be among the k best."""
    who, where = forest.search(proj, probes)
    order = np.argsort(where, kind="stable")
    who, where = who[order], where[order]
    starts = np.flatnonzero(np.r_[True, np.diff(where) > 0]) if len(where) else np.zeros(0, int)
    qs, hs = [], []
    for a, z in zip(starts, np.r_[starts[1:], len(where)]):
        rows, members = who[a:z], forest.members[where[a]]
        s = queries32[rows] @ home32[members].T
        if least is not None:
            i, j = np.nonzero(s >= least - 1e-4)
        else:
            keep = min(k + 1, len(members))
            j = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            i, j = np.repeat(np.arange(len(rows)), keep), j.ravel()
        qs.append(rows[i])
        hs.append(members[j])
    if not qs:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    pair = np.unique(np.concatenate(qs).astype(np.int64) * len(home) + np.concatenate(hs))
    q, h = pair // len(home), pair % len(home)
    sim = np.einsum("ij,ij->i", queries[q], home[h])
    if least is not None:
        keep = sim >= least
        q, h, sim = q[keep], h[keep], sim[keep]
    return q, h, sim


def _best(q: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best per query, equal ones by id."""
    order = np.lexsort((ids, -sim, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, np.diff(q) > 0]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _search_shards(dims: int, k: int, least: float | None, trees: int, leaf_rows: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and shard, home rows first."""
        pool = directions(dims, 2 * dims, 11)
        key, ids, raw, forest = None, [], [], None
        home = home32 = names = None

        def ready() -> None:
            nonlocal forest, home, home32, names
            names, at = np.unique(np.array(ids, object).astype(str), return_index=True)  # redelivered rows count once
            home = unit(decode([raw[i] for i in at], dims))
            home32 = home.astype(np.float32)
            forest = Forest(home32 @ pool, trees, leaf_rows, 5)

        def ask(qids: np.ndarray, q: np.ndarray) -> pa.RecordBatch | None:
            q32 = q.astype(np.float32)
            i, h, sim = exact_top(forest, home, home32, q, q32, q32 @ pool, k, probes, least)
            other = qids[i] != names[h]
            i, h, sim = i[other], h[other], sim[other]
            best = _best(i, names[h], sim, k)
            i, h, sim = i[best], h[best], sim[best]
            if len(i):
                return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(i), pa.string()), pa.array(qids[i].astype(object), pa.string()), pa.array(names[h].astype(object), pa.string()), pa.array(sim)], names=["g", "id", "neighbour", "cosine"])

        def finish() -> Iterator[pa.RecordBatch]:
            """The home rows ask last, when all of them are known."""
            if ids:
                if forest is None:
                    ready()
                for a in range(0, len(names), 8192):
                    if (out := ask(names[a : a + 8192], home[a : a + 8192])) is not None:
                        yield out

        for b in batches:
            g, shard, guest = b.column("g").to_pylist(), b.column("shard").to_numpy(), b.column("guest").to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(g)) if (g[i], shard[i], guest[i]) != (g[i - 1], shard[i - 1], guest[i - 1])), len(g)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if key != (g[a], shard[a]):
                    yield from finish()
                    key, ids, raw, forest = (g[a], shard[a]), [], [], None
                part = b.slice(a, z - a)
                pid, pv = part.column("id").to_pylist(), part.column("vec").to_pylist()
                if not guest[a]:
                    ids += pid
                    raw += pv
                elif ids:
                    if forest is None:
                        ready()
                    for s in range(0, len(pid), 8192):
                        qid, at = np.unique(np.array(pid[s : s + 8192], object).astype(str), return_index=True)
                        if (out := ask(qid, unit(decode([pv[s + i] for i in at], dims)))) is not None:
                            yield out
        yield from finish()

    return run


def _route(models: dict[str, Forest], dims: int, probes: int, margin: float, parts: int):
    """Adds to each row its home shard and the shards to search besides, and the
    partition of each: shards of trees one after another, other groups by hash."""
    starts, total = {}, 0
    for name, model in models.items():
        starts[name], total = total, total + len(model.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = directions(dims, dims, 3)
        for b in batches:
            g = np.array(b.column("g").to_pylist(), object)
            row, shard, guest, pid = [], [], [], []
            p = None
            for name in set(g):
                rows = np.flatnonzero(g == name)
                if name not in models:
                    row.append(rows), shard.append(np.zeros(len(rows), int)), guest.append(np.zeros(len(rows), bool)), pid.append(np.full(len(rows), zlib.crc32(name.encode()) % parts))
                    continue
                if p is None:
                    p = unit(decode(b.column("vec").to_pylist(), dims)).astype(np.float32) @ pool
                who, where = models[name].search(p[rows], max(probes, models[name].depth), margin)
                first = np.zeros(len(who), bool)
                first[np.unique(who, return_index=True)[1]] = True  # the home leaf was found first
                row.append(rows[who]), shard.append(where), guest.append(~first), pid.append((starts[name] + where) % parts)
            row = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pid), pa.int32()), b.column("g").take(row), pa.array(np.concatenate(shard), pa.int32()), pa.array(np.concatenate(guest)), b.column("id").take(row), b.column("vec").take(row)], names=["pid", "g", "shard", "guest", "id", "vec"])

    return run


def _coarse(vectors: DataFrame, dims: int, shard_rows: int, fit_rows: int) -> dict[str, Forest]:
    """A tree for each group with more than shard_rows rows; such groups number at
    most rows / shard_rows, and their trees hold rows / shard_rows leaves in all."""
    big = vectors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).limit(MAX_GROUPS_ON_DRIVER + 1).collect()
    if len(big) > MAX_GROUPS_ON_DRIVER:
        raise ValueError("raise shard_rows: too many groups need a tree")
    if not big:
        return {}
    total = sum(r["n"] for r in big)
    fit_rows = min(MAX_FIT_ROWS, max(fit_rows, 4 * total // shard_rows))
    share = max(1, total // fit_rows)
    names = F.broadcast(vectors.sparkSession.createDataFrame([(r["g"],) for r in big], "g string"))
    fit: dict[str, list] = {}
    for r in vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).join(names, "g").select("g", "vec").limit(2 * fit_rows).collect():
        fit.setdefault(r["g"], []).append(r["vec"])
    pool = directions(dims, dims, 3)
    out = {}
    for r in big:
        x = fit.get(r["g"])
        if x:
            p = unit(decode([bytes(v) for v in x], dims)).astype(np.float32) @ pool
            out[r["g"]] = tree = Forest(p, 1, max(2, shard_rows / r["n"] * len(x)), 7)
            tree.members = [np.zeros(0, int)] * len(tree.members)  # routing needs their number only
    return out


def nearest(
    df: DataFrame, *, group: str, key: str, vector: str, dims: int = 64, k: int = 5, least: float | None = None, shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS, shard_probes: int = SHARD_PROBES, shard_margin: float = SHARD_MARGIN, trees: int = TREES, leaf_rows: int = LEAF_ROWS, probes: int = PROBES
) -> DataFrame:
    """(g, id, neighbour, cosine, rank): for every id of df with a usable vector (see
    usable) the k others of its group with the largest cosine, found with the
    accuracy that the README states; only those of at least `least`, if given.

    vector is a column of JSON text. Rows with a null group, id or vector, or an
    unusable vector, have no row and are no neighbour. A repeated id counts once.
    Equal cosines rank by neighbour id. An empty table gives an empty result."""
    tmp = Scratch(df.sparkSession, "neighbours")
    v = tmp.save(parse(df.select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("id"), F.col(vector).cast("string").alias("text")), dims))
    same = v.groupBy("g", F.xxhash64("vec").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("g", "h")
    copies = None
    index = v
    if same.limit(1).count():
        same = tmp.save(same)
        alike = v.withColumn("h", F.xxhash64("vec")).join(same, ["g", "h"]).drop("h").dropDuplicates(["g", "id"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
        few = alike.withColumn("r", F.row_number().over(Window.partitionBy("g", "vec", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
        few = tmp.save(few.withColumn("r", F.row_number().over(Window.partitionBy("g", "vec").orderBy("id"))).where(F.col("r") <= k + 1).select("g", "vec", "id"))
        rest = tmp.save(alike.join(few.select("g", "id"), ["g", "id"], "left_anti").select("g", "id", "vec"))
        firsts = few.groupBy("g", "vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("near"))
        copies = rest.join(firsts, ["g", "vec"]).select("g", "id", F.posexplode("near").alias("rank", "neighbour")).select("g", "id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("rank") + 1).alias("rank"))
        index = v.join(rest.select("g", "id"), ["g", "id"], "left_anti")
    models = _coarse(v, dims, shard_rows, fit_rows)
    shards = sum(len(m.members) for m in models.values())
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards, -(-2 * v.count() // shard_rows))
    spread = index.mapInArrow(_route(models, dims, shard_probes, shard_margin, parts), "pid int, g string, shard int, guest boolean, id string, vec binary")
    spread = spread.repartitionById(parts, F.col("pid")).drop("pid").sortWithinPartitions("g", "shard", "guest", "id")
    found = spread.mapInArrow(_search_shards(dims, k, least, trees, leaf_rows, probes), "g string, id string, neighbour string, cosine double")
    order = Window.partitionBy("g", "id").orderBy(F.desc("cosine"), "neighbour")
    found = found.dropDuplicates(["g", "id", "neighbour"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.unionByName(copies) if copies is not None else found


def similar_assertions(assertions: DataFrame, k: int = 5, least: float | None = None, **how) -> DataFrame:
    """Problem 2: neighbours among the assertions of a tenant."""
    return nearest(assertions, group="tenant_id", key="assertion_id", vector="embedding_json", k=k, least=least, **how)


def close_pairs(assertions: DataFrame, k: int = 5, least: float = 0.90, **how) -> DataFrame:
    """(assertion_id_a, assertion_id_b), a < b, of cosine >= least where one is among the k nearest of the other."""
    near = similar_assertions(assertions, k, least, **how)
    return near.select(F.least("id", "neighbour").alias("assertion_id_a"), F.greatest("id", "neighbour").alias("assertion_id_b")).distinct()
