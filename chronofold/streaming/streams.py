"""Structured Streaming versions of the stateful operators.

Each takes a streaming DataFrame and gives one; run_once drives a stream over what
is there now and returns what it wrote, for batch use and tests. Checkpoints and
outputs lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_folder


def read(spark: SparkSession, path: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A Parquet file or folder as a stream with a watermark on its time column."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    src = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return src.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def first_per_key(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent intake: the first row of a key; its state goes with the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def counts_per_window(stream: DataFrame, time: str, size: str, by: list[str], slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("window_us"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    return stream.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("to_us"), *by, "n")


def transitions(stream: DataFrame) -> DataFrame:
    """Optimistic workflow transitions: (tenant_id, instance_id, revision, accepted)
    in order of arrival within a batch by revision; a revision is accepted if it is
    the next one and starts from the current state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, current = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["revision", "prior_state", "new_state"]).drop_duplicates(["revision", "prior_state", "new_state"])
        out = []
        for r, prior, new in zip(rows["revision"], rows["prior_state"], rows["new_state"]):
            ok = bool(r == revision + 1 and (revision == 0 or prior == current))
            if ok:
                revision, current = int(r), new
            out.append((key[0], key[1], int(r), ok))
        state.update((revision, current))
        yield pd.DataFrame(out, columns=["tenant_id", "instance_id", "revision", "accepted"])

    picked = stream.select("tenant_id", "instance_id", "revision", "prior_state", "new_state")
    return picked.groupBy("tenant_id", "instance_id").applyInPandasWithState(step, "tenant_id string, instance_id string, revision int, accepted boolean", "revision int, state string", "append", GroupStateTimeout.NoTimeout)


def expiries(stream: DataFrame, time: str, hold_seconds: int, key: str, done: str) -> DataFrame:
    """Event-time timers: (key, due_us) of keys whose hold ran out before a row
    with done arrived; fires when the watermark passes the due time."""

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due = state.get[0]
            state.remove()
            yield pd.DataFrame([(key_[0], due)], columns=["key", "due_us"])
            return
        rows = pd.concat(list(frames))
        if bool(rows["done"].any()):
            if state.exists:
                state.remove()
            return
        due = int(rows["us"].min()) + hold_seconds * 1_000_000 if not state.exists else state.get[0]
        state.update((due,))
        state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    picked = stream.select(F.col(key).cast("string").alias("key"), time, F.unix_micros(time).alias("us"), F.expr(done).alias("done"))
    return picked.groupBy("key").applyInPandasWithState(step, "key string, due_us bigint", "due bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Everything the stream gives for what is there now, from a Parquet sink (append)
    or, in complete mode, from the last batch."""
    spark = stream.sparkSession
    root = scratch_folder(spark, "stream")
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/state")
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", f"{root}/out").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out")).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return each(out) if each else out
