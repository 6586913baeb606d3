import random

import pytest

from chronofold.operators import hierarchy
from chronofold.plans import training

SCHEMA = "tenant_id string, assertion_id string, supersedes_assertion_id string, depth int, g string"


def _brute(rows):
    up, ids = {}, {(g, i) for g, i, *_ in rows}
    for g, i, p, *_ in rows:
        if p is not None and (g, p) in ids:
            up[g, i] = (g, p)
    out = {}
    for v in ids:
        path, u = [v], v
        while u in up and up[u] not in path:
            u = up[u]
            path.append(u)
        if u in up:
            ring = path[path.index(up[u]) :]
            out[v] = (-1, min(r[1] for r in ring), None, v in ring)
        else:
            out[v] = (len(path) - 1, path[-1][1], "/".join(p[1] for p in reversed(path)), False)
    return out


def _check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    h = hierarchy.supersession(df, linked_only=False)
    nodes = {(r["group_id"], r["node_id"]): r for r in h.nodes.collect()}
    want = _brute(rows)
    assert set(nodes) == set(want)
    paths = {(r["group_id"], r["node_id"]): r["path"] for r in h.paths().collect()}
    below = {(r["group_id"], r["ancestor_id"], r["descendant_id"]) for r in h.descendants().collect()}
    pairs = set()
    for v, (depth, root, path, on) in want.items():
        n = nodes[v]
        assert (n["depth"], n["root_id"], n["on_cycle"]) == (depth, root, on), v
        assert paths.get(v) == path
        if path:
            pairs |= {(v[0], a, v[1]) for a in path.split("/")[:-1]}
    assert below == pairs
    for v, n in nodes.items():
        if n["depth"] >= 0:
            inside = {m["node_id"] for u, m in nodes.items() if u[0] == v[0] and m["root_id"] == n["root_id"] and m["depth"] >= 0 and n["preorder"] <= m["preorder"] < n["preorder"] + n["subtree_size"]}
            assert inside == {v[1]} | {d for g, a, d in pairs if (g, a) == v}
            assert len(n["segments"]) <= max(1, len(nodes)).bit_length()
    linked = {r["node_id"] for r in hierarchy.supersession(df).nodes.collect()}
    assert {v[1] for v in want if any(r[0] == v[0] and r[1] == v[1] and r[2] is not None for r in rows)} <= linked


def test_random_forest_with_cycles(spark):
    r = random.Random(5)
    rows = []
    for g in "ab":
        for i in range(30):
            rows.append((g, f"{g}{i:02d}", r.choice([None, "", "gone", *[f"{g}{j:02d}" for j in range(i)]]) if r.random() < 0.9 else f"{g}{r.randrange(30):02d}"))
    _check(spark, rows + rows[:7])


def test_chain_star_rings_and_self(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHILDREN_PER_TASK", 4)
    rows = [("t", "c00", None)] + [("t", f"c{i:02d}", f"c{i - 1:02d}") for i in range(1, 14)]
    rows += [("t", f"s{i}", "c02") for i in range(9)]
    rows += [("t", "self", "self"), ("t", "x1", "x2"), ("t", "x2", "x3"), ("t", "x3", "x1"), ("t", "tail1", "x2"), ("t", "tail2", "tail1"), ("u", "c05", "c04")]
    _check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, "a", "b"), ("t", None, "a")], [("t", "a", None)]])
def test_empty_and_null(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert hierarchy.supersession(df, linked_only=False).nodes.count() == len([r for r in rows if r[0] and r[1]])


def test_queries_hold_assertions_without_links(spark, tmp_path):
    rows = [("t", "a", None), ("t", "b", "a"), ("t", "alone", None), ("t", "x", "x")]
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).write.parquet(str(tmp_path / "assertions.parquet"))
    paths = {r["assertion_id"]: r["path"] for r in training.p3_paths(spark, str(tmp_path)).collect()}
    assert paths == {"a": "a", "b": "a/b", "alone": "alone"}
    sizes = {r["assertion_id"]: r["subtree_size"] for r in training.p3_subtrees(spark, str(tmp_path)).collect()}
    assert sizes == {"a": 2, "b": 1, "alone": 1}
