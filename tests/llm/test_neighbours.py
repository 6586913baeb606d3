import json
import random

import numpy as np
import pytest

from chronofold.llm import entries
from chronofold.llm import neighbours as N

DIMS = 16
SCHEMA = "tenant_id string, assertion_id string, embedding_json string, g string, vec string, rank int"


def _clusters(n_clusters, size, noise, seed, dims=DIMS):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n_clusters, dims))
    return np.concatenate([b + noise * r.standard_normal((size, dims)) for b in base]) * r.uniform(0.5, 5, (n_clusters * size, 1))


def _table(spark, vectors, tenants=("a", "b"), texts=json.dumps):
    r = random.Random(1)
    rows = [(r.choice(tenants), f"v{i:05d}", texts([round(float(x), 4) for x in v]), "x", "y", 1) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _brute(rows, k, dims=DIMS):
    out = {}
    for t in {r[0] for r in rows}:
        own = {r[1]: N.usable(r[2], dims) for r in rows if r[0] == t}
        own = {i: v for i, v in own.items() if v}
        ids = sorted(own)
        x = N.unit(np.array([own[i] for i in ids]))
        s = x @ x.T
        np.fill_diagonal(s, -9)
        for i, row in zip(ids, s):
            best = sorted(zip(-row, ids))[: min(k, len(ids) - 1)]
            out[t, i] = [(j, -c) for c, j in best]
    return out


def test_usable():
    ok = [0.5] * 3 + [0]
    assert N.usable(json.dumps(ok), 4) == ok
    assert N.usable("[1e-3, 2E+1, -0.0, 3]", 4) == [0.001, 20.0, 0.0, 3.0]
    for bad in (None, "", "[]", "x", "[1,2,3]", "[1,2,3,4,5]", "[0,0,0,0]", "[1,2,3,null]", "[1,2,3,NaN]", "[1,2,3,Infinity]", "[1,2,3,1e999]", '["1",2,3,4]', "[true,2,3,4]", "{}", "[[1],2,3,4]", "[" * 5000, "[1,2,3,1" + "0" * 400 + "]"):
        assert N.usable(bad, 4) is None, bad


def test_codec_is_exact():
    x = np.array([[0.1234, -3.2767, 0, 2], [0.12345, 1, 2, 3], [1e-300, 5, 6, 1e300]])
    raw = N.encode(x)
    assert [len(b) for b in raw] == [8, 32, 32]
    assert (N.decode(raw, 4) == x).all()


@pytest.mark.parametrize("shard_rows", [40_000, 60])
def test_recall_against_brute_force(spark, shard_rows):
    rows, df = _table(spark, _clusters(80, 6, 0.15, 3))
    want = _brute(rows, 5)
    got = {}
    for r in N.similar_assertions(df, 5, dims=DIMS, shard_rows=shard_rows, leaf_rows=16).collect():
        got.setdefault((r["g"], r["id"]), []).append((r["neighbour"], r["cosine"], r["rank"]))
    assert set(got) == set(want)
    close = {(k, j) for k, v in want.items() for j, c in v if c >= 0.9}
    found = {(k, j) for k, v in got.items() for j, _, _ in v}
    assert len(close) > 500 and len(close & found) / len(close) >= 0.95
    for k, v in got.items():
        exact = dict(want[k])
        assert sorted(x[2] for x in v) == list(range(1, len(v) + 1))
        assert all(abs(exact[j] - c) < 1e-9 for j, c, _ in v if j in exact)


def test_least_gives_the_same_close_pairs(spark):
    rows, df = _table(spark, _clusters(40, 8, 0.15, 4))
    want = {tuple(sorted((k[1], j))) for k, v in _brute(rows, 5).items() for j, c in v if c >= 0.9}
    got = {tuple(r) for r in N.close_pairs(df, 5, 0.9, dims=DIMS).collect()}
    assert all(a < b for a, b in got) and len(got & want) / len(want) >= 0.97


def test_copies_repeats_and_unusable_rows(spark):
    v = _clusters(3, 1, 0, 5)
    rows = [("a", f"c{i:03d}", json.dumps([round(float(x), 4) for x in v[0]], separators=(", ", ": ") if i % 2 else (",", ":")), "x", "y", 1) for i in range(40)]
    rows += [("a", "other", json.dumps(v[1].tolist()), "x", "y", 1), ("a", None, json.dumps(v[1].tolist()), "x", "y", 1), (None, "n", json.dumps(v[1].tolist()), "x", "y", 1), ("a", "bad", "[1]", "x", "y", 1), ("b", "alone", json.dumps(v[2].tolist()), "x", "y", 1)]
    df = spark.createDataFrame(rows + rows[:10], SCHEMA)
    got = {}
    for r in N.similar_assertions(df, 5, dims=DIMS).collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
    assert set(got) == {f"c{i:03d}" for i in range(40)} | {"other"}
    for i in range(40):
        mine = got[f"c{i:03d}"]
        assert len(mine) == len(set(mine)) == 5 and all(j != f"c{i:03d}" and j.startswith("c") and c == pytest.approx(1) for j, c in mine)
    assert N.similar_assertions(df.limit(0), 5, dims=DIMS).count() == 0


def test_query_gives_every_vector_its_nearest(spark, tmp_path):
    rows, df = _table(spark, np.random.default_rng(6).standard_normal((6000, 64)), tenants=("a",) * 9 + ("b",))
    df.write.parquet(str(tmp_path / "assertions.parquet"))
    got = {}
    for r in entries.p2_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["assertion_id"], []).append(r["neighbour_id"])
    want = {k[1]: {j for j, _ in v} for k, v in _brute(rows, 5, 64).items()}
    assert set(got) == set(want) and all(len(v) == len(set(v)) == 5 for v in got.values())
    assert sum(len(want[i] & set(v)) for i, v in got.items()) / (5 * len(want)) >= 0.9
