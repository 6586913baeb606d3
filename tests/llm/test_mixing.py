import math
from pathlib import Path

import pandas as pd

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 40), min_size=1))
def test_schedule_keeps_within_one_block(blocks):
    total = sum(blocks.values())
    plan = mixing.schedule(blocks)
    assert sorted((s, j) for _, s, j in plan) == sorted((s, j) for s, n in blocks.items() for j in range(n))
    done = dict.fromkeys(blocks, 0)
    for slot, s, j in plan:
        assert j == done[s]
        done[s] += 1
        for x, n in blocks.items():
            assert abs(done[x] - n * (slot + 1) / total) < 1


def _mix(spark, counts, targets, **how):
    rows = [(f"{s}{i}", s if i % 2 else f" {s.upper().replace('_', '-')} ", 100 + i % 7) for s, n in counts.items() for i in range(n)]
    rows += rows[:3] + [("n", None, 5), (None, "big", 5), ("u", "unlisted", 5), ("z", "big", 0)]
    r = spark.createDataFrame(rows, "doc_id string, source string, n_tokens bigint").selectExpr("*", "1 as start", "2 as bucket", "3 as n")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m, rep = mixing.mix(r, t, **how)
    return m.collect(), {x["source"]: x for x in rep.collect()}


def test_shares_repeats_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 500)
    monkeypatch.setattr(mixing, "RECORDS_PER_BUCKET", 37)
    rows, rep = _mix(spark, {"big": 2000, "mid_one": 300, "small": 40}, [("big", 0.7, 1), ("Mid-One", 0.2, 2), ("small", 0.1, 3), ("absent", 0.05, 9)])
    assert rep["absent"]["actual_share"] == 0 and rep["absent"]["tokens"] == 0
    for s, w in (("big", 0.7), ("mid_one", 0.2), ("small", 0.1)):
        assert rep[s]["actual_share"] == pytest.approx(w, abs=0.01)
        assert 1 <= rep[s]["most_repeats"] <= rep[s]["max_repeats"]
    assert rep["small"]["n_used"] == 120
    uses = {}
    for r in rows:
        uses.setdefault((r["source"], r["record_id"]), []).append(r["repeat_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in uses.values())
    order, done, total = sorted(rows, key=lambda r: (r["slot"], r["source"], r["start"])), dict.fromkeys(("big", "mid_one", "small"), 0), 0
    for r in order:
        done[r["source"]] += r["n_tokens"]
        total += r["n_tokens"]
        assert all(abs(done[s] - w * total) < 2 * 500 for s, w in (("big", 0.7), ("mid_one", 0.2), ("small", 0.1)))


def test_larger_total_takes_all_of_scarce_sources(spark):
    _, rep = _mix(spark, {"big": 500, "small": 10}, [("big", 0.5, 1), ("small", 0.5, 2)], total=30_000)
    assert rep["small"]["n_used"] == 20 and rep["small"]["actual_share"] < 0.5 and math.isclose(rep["big"]["used_tokens"], 15_000, rel_tol=0.02)


def test_empty(spark):
    rows, rep = _mix(spark, {}, [("big", 1.0, 1)])
    assert rows == [] and rep["big"]["used_tokens"] == 0


def _largest_deviation(rows, weight):
    """Over every prefix and source: tokens from its share. Also checks that positions have no gap."""
    done, total, most = dict.fromkeys(weight, 0), 0, 0
    for r in sorted(rows, key=lambda r: r["slot"]):
        assert r["slot"] == total
        done[r["source"]] += r["n_tokens"]
        total += r["n_tokens"]
        most = max([most, *(abs(done[s] - weight[s] * total) for s in weight)])
    return most


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 50), st.integers(0, 9)), min_size=1), st.integers(1, 120), st.integers(1, 5))
def test_frames_keep_every_prefix_within_two_records(sources, longest, n_frames):
    """Records of very different length, whatever the number of frames; none is lost."""
    import random

    rows, ends = [], {}
    quota = {s: w * 60 for s, (w, _) in sources.items()}
    total = sum(quota.values())
    weight = {s: q / total for s, q in quota.items()}
    for s, q in quota.items():
        r, at = random.Random(sources[s][1]), 0
        while at < q:
            n = r.choice([1, r.randint(1, longest), longest])
            if at + n / 2 <= q:
                rows.append({"source": s, "start": at, "record_id": f"{s}{at}", "repeat_no": 1, "n_tokens": n})
            at += n
    frame = max(total / n_frames, *((longest + 2) / w for w in weight.values()))
    order, out = mixing._frame_order(weight, frame), []
    for f in range(int((total + longest) / frame) + 2):
        touching = [x | {"frame": f} for x in rows if x["start"] + x["n_tokens"] + 1 >= weight[x["source"]] * f * frame and x["start"] - 1 <= weight[x["source"]] * (f + 1) * frame]
        if touching:
            out += order(pd.DataFrame(touching)).to_dict("records")
    assert sorted(x["record_id"] for x in out) == sorted(x["record_id"] for x in rows)
    # Near the end of the mixture the sources run out, each within half a record of its quota.
    assert _largest_deviation([x for x in out if x["slot"] + x["n_tokens"] <= total - longest * len(weight)], weight) < 2 * longest


def test_real_texts_stay_within_a_block(spark):
    from chronofold.llm import entries, tokens

    folder = "/root/testdata/sf0.01"
    if not Path(tokens.VOCABULARY).exists() or not Path(folder).exists():
        pytest.skip("no vocabulary or data")
    mixture, report = mixing.mix(entries._sizes(spark, folder), entries.table(spark, folder, "source_targets"), frame_records=100)
    rows, used = mixture.collect(), {r["source"]: r["target_share"] for r in report.collect() if r["used_tokens"]}
    weight = {s: w / sum(used.values()) for s, w in used.items()}
    assert _largest_deviation(rows, weight) < max(mixing.LEAST_BLOCK, 2 * max(r["n_tokens"] for r in rows))
