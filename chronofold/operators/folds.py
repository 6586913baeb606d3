"""Sequential folds that no running sum can express, and effect bookkeeping.

A fold is serial per key by nature. Rows are partitioned and sorted by key and
order, and streamed through Python in Arrow batches with one key's state at a
time, so a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type
from pyspark.sql.window import Window

from ..functions.scalars import retry_seconds


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], object], step: Callable[[object, tuple], tuple[object, tuple]], inputs: list[str], outputs: str) -> DataFrame:
    """keys, order and the outputs of each row. start(first inputs) gives the state
    of a key; step(state, inputs) gives the next state and the row's outputs."""
    made = parse_type(outputs)
    cols = [*keys, *order]
    schema = StructType([*df.select(*cols).schema.fields, *(StructField(f.name, f.dataType) for f in made.fields)])
    nk, no, names = len(keys), len(cols), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in made.fields]
        key, state = None, None
        for b in batches:
            rows, out = zip(*(c.to_pylist() for c in b.columns)), []
            for r in rows:
                if r[:nk] != key:
                    key, state = r[:nk], start(r[no:])
                state, o = step(state, r[no:])
                out.append(o)
            yield pa.RecordBatch.from_arrays([*b.columns[:no], *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], names=names)

    picked = df.select(*cols, *(F.col(c).alias(f"in_{i}_") for i, c in enumerate(inputs)))
    return picked.repartition(*keys).sortWithinPartitions(*cols).mapInArrow(run, schema)


def admit(requests: DataFrame, keys: list[str], order: list[str], quantity: str, capacity: str) -> DataFrame:
    """keys, order, admitted, used: a request is admitted if it fits what is left of
    its key's capacity; a rejected one uses nothing. Null or negative quantities
    are rejected; a null capacity is 0."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        capacity, used = state
        ok = row[0] is not None and 0 <= row[0] <= capacity - used
        used += row[0] if ok else 0
        return (capacity, used), (ok, used)

    return fold(requests, keys, order, lambda r: (r[1] or 0, 0), step, [quantity, capacity], "admitted boolean, used bigint")


def lease_next(effects: DataFrame, now: Column, limit_per_tenant: int = 1) -> DataFrame:
    """The oldest effects of each tenant that are due: planned or unknown, with the
    retry delay since their last update past."""
    due = effects.where(F.col("status").isin("planned", "unknown") & (F.unix_micros("updated_at") + retry_seconds("attempt_count").cast("long") * 1_000_000 <= F.unix_micros(now)))
    due = due.groupBy("tenant_id", "effect_id").agg(F.min("created_at").alias("created_at"))
    w = Window.partitionBy("tenant_id").orderBy("created_at", "effect_id")
    return due.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit_per_tenant)


def rotation(tenants: DataFrame, cursor: str) -> DataFrame:
    """Tenants in the order they are served after cursor, going round."""
    after = F.col("tenant_id") > cursor
    return tenants.select("tenant_id").distinct().withColumn("turn", F.row_number().over(Window.orderBy(F.when(after, 0).otherwise(1), "tenant_id")))


def classify(mode: Column, code: Column, has_reference: Column) -> Column:
    """Outcome of a delivery or reconciliation by its response code."""
    retry = code.isin(408, 409, 425, 429) | (code >= 500) | ((mode == "reconcile") & (code == 404))
    return F.when(code.between(200, 299) & has_reference, "succeeded").when(code.between(200, 299) | retry | code.isNull(), "unknown").otherwise("failed")


def totals_by_outcome(effects: DataFrame) -> DataFrame:
    """Amounts that are settled, still held and released, per tenant and currency."""
    rows = effects.where("budget_amount is not null").dropDuplicates(["tenant_id", "effect_id"])
    amount = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("budget_amount"))), F.lit(0)).cast("decimal(30,4)")
    return rows.groupBy("tenant_id", F.coalesce("currency", F.lit("")).alias("currency")).agg(amount("succeeded").alias("settled"), amount("planned", "unknown").alias("held"), amount("failed", "cancelled").alias("released"), F.count(F.lit(1)).alias("n"))
