"""Mixing sources to target weights, by Pfair scheduling.

Every record is a block of work of its source. With weight w, the block that starts
after `start` tokens of its source and is n tokens long is released as soon as placing
it keeps the source less than its own length ahead of its share, and is due when its
share reaches its end, (start + n) / w; of the released blocks the one with the
earliest deadline goes first. As starts count tokens, what a long record runs over is
carried into the release of the next one.

So that no task holds the whole mixture, it is cut into frames of equal share, which
are scheduled side by side. A record across the end of a frame goes to the frame
before or after it, chosen so that the frame ends within half a record of its due
length whatever the number of sources. After every record each source is therefore
within one block of its share, a block being twice the longest record, however long
the mixture is.

The total is the largest at which every source that has records reaches its
share without a record being used more than max_repeats times; a larger total may
be asked for, and scarce sources then give all they have. Positions within a
source are running sums in buckets of a hash order, so no source is sorted or
summed in one task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch

#: Least length of a block in tokens; twice the longest record if that is more.
LEAST_BLOCK = 16_384
#: Records a frame holds on average.
FRAME_RECORDS = 100_000
MAX_SOURCES = 10_000
RECORDS_PER_BUCKET = 50_000


def canonical_source(c: Column | str) -> Column:
    """One spelling for a source: lower case, trimmed, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"[\s\-_]+", "_")


def interleave(queues: dict[str, list[tuple]], weight: dict, placed) -> list[tuple]:
    """(position, source, place in its queue) in order, from position `placed` on.
    queues: (start, size) of the blocks of each source in order; weights sum to 1."""
    waiting: list[tuple] = []  # (when released, source, place)
    ready: list[tuple] = []  # (deadline, -weight, source, place)
    out = []

    def come(s: str, j: int) -> None:
        if j < len(queues[s]):
            start, size = queues[s][j]
            heapq.heappush(waiting, (start / weight[s] - size, s, j))

    for s in queues:
        come(s, 0)
    while waiting or ready:
        while waiting and (waiting[0][0] < placed or not ready):
            _, s, j = heapq.heappop(waiting)
            start, size = queues[s][j]
            heapq.heappush(ready, ((start + size) / weight[s], -weight[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((placed, s, j))
        placed += queues[s][j][1]
        come(s, j + 1)
    return out


def schedule(blocks: dict[str, int]) -> list[tuple[int, str, int]]:
    """(slot, source, block) for the number of equal blocks of each source."""
    total = sum(blocks.values())
    return interleave({s: [(j, 1) for j in range(n)] for s, n in blocks.items() if n}, {s: Fraction(n, total) for s, n in blocks.items() if n}, 0)


def _balance(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of records across the end of a frame: whether each goes to the next frame.
    before and after: its tokens on either side. Keeps the sum of what the frame
    lacks and exceeds within half the longest record."""
    late = np.zeros(len(before), bool)
    balance = 0
    for i, (x, y) in enumerate(zip(before.tolist(), after.tolist())):
        late[i] = abs(balance - x) < abs(balance + y)
        balance += -x if late[i] else y
    return late


def _frame_order(weight: dict[str, float], frame_tokens: float):
    """Orders a frame from the records that touch it or nearly do. Records across its
    ends come with both frames and are given to the same one by both."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = int(pdf["frame"].iloc[0])
        pdf = pdf.sort_values(["source", "start"], ignore_index=True)
        share, start = pdf["source"].map(weight).to_numpy(float), pdf["start"].to_numpy(np.int64)
        end = start + pdf["n_tokens"].to_numpy(np.int64)
        cut = lambda edge: np.floor(share * edge * frame_tokens).astype(np.int64)
        low, high = cut(frame), cut(frame + 1)
        mine = (start >= low) & (end <= high)
        begin = sum(int(np.floor(w * frame * frame_tokens)) for w in weight.values())
        for edge, late_is_mine in ((low, True), (high, False)):
            across = np.flatnonzero((start < edge) & (end > edge))
            late = _balance((edge - start)[across], (end - edge)[across])
            mine[across] = late if late_is_mine else ~late
            if late_is_mine:
                begin += int(np.where(late, (start - edge)[across], (end - edge)[across]).sum())
        rows = pdf[mine].reset_index(drop=True)
        queues, at = {}, {}
        for s, g in rows.groupby("source", sort=True):
            queues[s], at[s] = list(zip(g["start"].tolist(), g["n_tokens"].tolist())), g.index.to_numpy()
        order = interleave(queues, weight, begin)
        out = rows.iloc[[at[s][j] for _, s, j in order]].assign(slot=[p for p, _, _ in order])
        return out[["slot", "source", "start", "record_id", "repeat_no", "n_tokens"]]

    return run


def mix(records: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "n_tokens", total: int | None = None, frame_records: int = FRAME_RECORDS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: slot (tokens of the mixture before the record, which
    gives the order), source, start (tokens of the source before it), record_id,
    repeat_no (from 1), n_tokens. report: a row for each target with what it has and
    what it gave.

    Records of null or unlisted source, null key or a size under 1 are left out; a
    repeated key counts once. Sources are compared by canonical_source. A target
    without records gives nothing and its share falls to the others in proportion.
    Empty tables give an empty mixture."""
    tmp = Scratch(records.sparkSession, "mixing")
    goal = {}
    for r in targets.select(canonical_source("source").alias("s"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect():
        if r["s"] is not None:
            goal[r["s"]] = (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0))
    if len(goal) > MAX_SOURCES:
        raise ValueError("too many sources")
    rows = records.select(canonical_source(source).alias("source"), F.col(key).cast("string").alias("record_id"), F.col(size).cast("long").alias("n")).where("n > 0 and record_id is not null").where(F.col("source").isin(list(goal)))
    rows = tmp.save(rows.groupBy("source", "record_id").agg(F.max("n").alias("n")))
    stats = rows.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.max("n").alias("most")).collect()
    have = {r["source"]: (r["n"], r["c"]) for r in stats}
    live = {s: w for s, (w, m) in goal.items() if w > 0 and m > 0 and s in have}
    weight = {s: w / sum(live.values()) for s, w in live.items()}
    most = min((goal[s][1] * have[s][0] / weight[s] for s in live), default=0)
    size_ = total if total is not None else int(most)
    quota = {s: min(round(size_ * weight[s]), goal[s][1] * have[s][0]) for s in live}
    spark = records.sparkSession
    used = {s: q / sum(quota.values()) for s, q in quota.items() if q}
    longest = max((r["most"] for r in stats if r["source"] in used), default=1)
    block = max(LEAST_BLOCK, 2 * longest)
    mean = sum(have[s][0] for s in used) / max(1, sum(have[s][1] for s in used))
    # A frame has room for every source's longest record, so that a record crosses one end at most.
    frame = max(block, frame_records * mean, *((longest + 2) / w for w in used.values())) if used else 1
    how = F.broadcast(spark.createDataFrame([(s, quota[s], have[s][0], min(goal[s][1], -(-quota[s] // have[s][0])), -(-have[s][1] // RECORDS_PER_BUCKET), used[s]) for s in used], "source string, quota bigint, tokens bigint, epochs int, buckets bigint, weight double"))
    placed = rows.join(how, "source").withColumn("order_", F.xxhash64(F.lit(seed), "record_id")).withColumn("bucket", F.pmod("order_", "buckets"))
    inside = Window.partitionBy("source", "bucket").orderBy("order_", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket").agg(F.sum("n").alias("b")).select("source", "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    placed = placed.withColumn("in_", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["source", "bucket"])
    placed = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), "epochs"))).withColumn("start", (F.col("repeat_no") - 1) * F.col("tokens") + F.col("base") + F.col("in_"))
    chosen = placed.where(F.col("start") + F.col("n") / 2 <= F.col("quota")).select("source", "start", "record_id", "repeat_no", F.col("n").alias("n_tokens"), (F.lit(float(frame)) * F.col("weight")).alias("share_"))
    first = F.greatest(F.lit(0), F.floor((F.col("start") - 1) / F.col("share_")))
    last = F.floor((F.col("start") + F.col("n_tokens") + 1) / F.col("share_"))
    framed = chosen.withColumn("frame", F.explode(F.sequence(first, last))).drop("share_")
    mixture = framed.groupBy("frame").applyInPandas(_frame_order(used, float(frame)), "slot bigint, source string, start bigint, record_id string, repeat_no int, n_tokens bigint")
    mixture = tmp.save(mixture)
    given = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_used"), F.max("repeat_no").alias("most_repeats"))
    listed = spark.createDataFrame([(s, w, m, have.get(s, (0, 0))[0], have.get(s, (0, 0))[1]) for s, (w, m) in goal.items()], "source string, target_share double, max_repeats int, tokens bigint, n_records bigint")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = listed.join(given, "source", "left").select("source", "target_share", "max_repeats", "tokens", "n_records", zero("used_tokens"), zero("n_used"), zero("most_repeats"))
    return mixture, out.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))
