"""References to records that do not exist, by compressed bitmaps.

Keys are hashed to ranges of about KEYS_PER_RANGE rows. Within a range a
dictionary turns keys into dense integers; references become one bitmap per
field and period, parents become bitmaps of those that exist, of those not
deleted, and, per period, of those recorded before it. Reference AND-NOT parent
leaves the orphans, whose bits are decoded to keys and then to records. Only
parents recorded in the very period of a reference need their times compared.

References to one hot key are split over ranges and its parent row copied to
each, so a range stays bounded and is streamed through one task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_key, hot_splits, us, with_splits

ROWS_PER_RANGE = 65_536
REFS_PER_SPLIT = 50_000


class Bitmap:
    """A set of integers in chunks of 65,536: a sorted uint16 array while a chunk
    holds up to 4,096 of them, a bit array beyond."""

    LIMIT = 4096

    def __init__(self, values: np.ndarray | None = None):
        self.chunks: dict[int, np.ndarray] = {}
        if values is not None and len(values):
            v = np.unique(values.astype(np.int64))
            high = v >> 16
            cut = np.flatnonzero(np.diff(high)) + 1
            for part in np.split(v, cut):
                self._put(int(part[0] >> 16), (part & 0xFFFF).astype(np.uint16))

    def _put(self, high: int, low: np.ndarray) -> None:
        if len(low) > self.LIMIT:
            flags = np.zeros(65_536, np.bool_)
            flags[low] = True
            self.chunks[high] = np.packbits(flags)
        elif len(low):
            self.chunks[high] = low

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16)

    @staticmethod
    def _has(chunk: np.ndarray, low: np.ndarray) -> np.ndarray:
        if chunk.dtype == np.uint16:
            at = np.searchsorted(chunk, low)
            return (at < len(chunk)) & (chunk[np.minimum(at, len(chunk) - 1)] == low)
        return (chunk[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1

    def and_not(self, other: Bitmap) -> Bitmap:
        out = Bitmap()
        for high, a in self.chunks.items():
            b = other.chunks.get(high)
            if b is None:
                out.chunks[high] = a
            elif a.dtype == b.dtype == np.uint8:
                out._put(high, self._low(a & ~b))
            else:
                low = self._low(a)
                out._put(high, low[~self._has(b, low)])
        return out

    def union(self, other: Bitmap) -> Bitmap:
        return Bitmap(np.concatenate([self.decode(), other.decode()]))

    def decode(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *((h << 16) + self._low(c).astype(np.int64) for h, c in sorted(self.chunks.items()))])


REASONS = np.array(["missing", "deleted", "late"])


def _range_orphans(key: np.ndarray, field: np.ndarray, period: np.ndarray, at: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of orphans and their reasons. key: dictionary codes; field: -1 for parents."""
    is_parent = field < 0
    pk, pt, pp = key[is_parent], at[is_parent], period[is_parent]
    exists, dead = Bitmap(pk), Bitmap(pk[gone[is_parent]])
    alive = exists.and_not(dead)
    recorded = np.full(int(key.max()) + 1, -(2**63), np.int64)
    np.maximum.at(recorded, pk, pt)
    rows, why = [], []
    refs = np.flatnonzero(~is_parent)
    order = refs[np.lexsort((period[refs], field[refs]))]
    cuts = np.flatnonzero(np.diff(field[order]) | np.diff(period[order])) + 1 if len(order) else []
    last = np.full(len(recorded), -1, np.int64)
    np.maximum.at(last, pk, pp)
    for part in np.split(order, cuts):
        if not len(part):
            continue
        refs_here = Bitmap(key[part])
        missing = refs_here.and_not(exists)
        deleted = refs_here.and_not(alive).and_not(missing)
        earlier = Bitmap(np.flatnonzero(last < period[part[0]]))
        maybe_late = refs_here.and_not(missing).and_not(deleted).and_not(earlier)
        reason = np.full(len(recorded), -1, np.int8)
        for n, bits in enumerate((missing, deleted, maybe_late)):
            reason[bits.decode()] = n
        r = reason[key[part]]
        hit = (r >= 0) & ((r < 2) | (recorded[key[part]] > at[part]))
        rows.append(part[hit])
        why.append(r[hit])
    return (np.concatenate(rows), np.concatenate(why)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come in order of range_; one range is held at a time."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        codes = t["key_"].combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        n = lambda c: t[c].to_numpy()
        rows, why = _range_orphans(codes.indices.to_numpy(), n("field_").astype(np.int64), n("period_"), n("at_"), n("gone_"))
        out = t.take(pa.array(rows)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) and c.num_chunks != 1 else c.chunk(0) for c in (out["field_"].cast(pa.int32()), out["record_"], out["period_"])), pa.array(REASONS[why])], names=["field_", "record_id", "period_", "reason"]) if len(rows) else None

    held: list[pa.RecordBatch] = []
    for b in batches:
        r = b.column("range_").to_numpy()
        ends = [*(np.flatnonzero(np.diff(r)) + 1), len(r)]
        start = 0
        for end in ends:
            if held and start < end and held[0].column("range_")[0].as_py() != r[start]:
                if (out := solve(held)) is not None:
                    yield out
                held = []
            if end > start:
                held.append(b.slice(start, end - start))
            start = end
    if held and (out := solve(held)) is not None:
        yield out


def find(references: dict[str, DataFrame], parents: dict[str, DataFrame], targets: dict[str, str]) -> DataFrame:
    """ref_field, record_id, period (yyyymm of the referring row), reason.

    references: by field, with columns scope, key, record_id, at (timestamp);
    parents: by name, with columns scope, key, gone (boolean), at; targets: the
    parent of each field. A null key is no reference, an empty string is one; a
    null scope or record_id is left out; a null time is never late and falls in
    period 0; a parent row with a null gone is not deleted. Repeated rows count
    once if they are alike; of unlike copies one deleted makes the parent deleted
    and the latest time counts. Empty tables are allowed."""
    fields, names = sorted(references), sorted(parents)
    period = F.coalesce(F.year("at") * 100 + F.month("at"), F.lit(0))
    plain = lambda df, at: (F.lit(names.index(at)).cast("string"), F.col("scope").cast("string"), F.col("key").cast("string"))
    refs = parts = None
    for i, f in enumerate(fields):
        d = references[f]
        d = d.select(*(c.alias(n) for c, n in zip(plain(d, targets[f]), ("to_", "scope", "key"))), F.col("record_id").cast("string").alias("record_"), F.lit(i).alias("field_"), period.alias("period_"), F.coalesce(us("at"), F.lit(2**63 - 1)).alias("at_"), F.lit(False).alias("gone_"))
        refs = d if refs is None else refs.unionByName(d)
    for p in names:
        d = parents[p]
        d = d.select(*(c.alias(n) for c, n in zip(plain(d, p), ("to_", "scope", "key"))), F.lit(None).cast("string").alias("record_"), F.lit(-1).alias("field_"), period.alias("period_"), F.coalesce(us("at"), F.lit(-(2**63))).alias("at_"), F.coalesce("gone", F.lit(False)).alias("gone_"))
        parts = d if parts is None else parts.unionByName(d)
    key = fold_key("to_", "scope", "key").alias("key_")
    cols = ["record_", "field_", "period_", "at_", "gone_"]
    refs = refs.dropna(subset=["scope", "key", "record_"]).select(key, *cols)
    parts = parts.dropna(subset=["scope", "key"]).select(key, *cols)
    ranges = max(1, (sum(d.count() for d in [*references.values(), *parents.values()])) // ROWS_PER_RANGE)
    hot = hot_splits(refs, ["key_"], REFS_PER_SPLIT, "splits_")
    refs = with_splits(refs, hot, ["key_"], "splits_").withColumn("split_", F.pmod(F.xxhash64("record_"), F.col("splits_")).cast("int"))
    parts = with_splits(parts, hot, ["key_"], "splits_").withColumn("split_", F.explode(F.sequence(F.lit(0), F.col("splits_") - 1)) if hot is not None else F.lit(0))
    both = refs.unionByName(parts).withColumn("range_", F.pmod(F.xxhash64("key_", "split_"), F.lit(ranges)).cast("int")).select("range_", "key_", *cols)
    found = both.repartition("range_").sortWithinPartitions("range_").mapInArrow(_search, "field_ int, record_id string, period_ int, reason string")
    name = F.element_at(F.array(*(F.lit(f) for f in fields)), F.col("field_") + 1)
    return found.select(name.alias("ref_field"), "record_id", F.col("period_").alias("period"), "reason").distinct()


def ledger_orphans(effects: DataFrame, assertions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Problem 5, see find."""
    gone = (F.col("status") == "deleted").alias("gone")
    ref = lambda df, key, rid, at: df.where(F.col(key).isNotNull()).select(F.col("tenant_id").alias("scope"), F.col(key).alias("key"), F.col(rid).alias("record_id"), F.col(at).alias("at"))
    return find(
        {
            "effect_intents.decision_assertion_id": ref(effects, "decision_assertion_id", "effect_id", "created_at"),
            "effect_intents.policy_assertion_id": ref(effects, "policy_assertion_id", "effect_id", "created_at"),
            "assertions.source_artifact_id": ref(assertions, "source_artifact_id", "assertion_id", "system_from"),
        },
        {
            "assertions": assertions.select(F.col("tenant_id").alias("scope"), F.col("assertion_id").alias("key"), gone, F.col("system_from").alias("at")),
            "artifacts": artifacts.select(F.col("tenant_id").alias("scope"), F.col("artifact_id").alias("key"), gone, F.col("created_at").alias("at")),
        },
        {"effect_intents.decision_assertion_id": "assertions", "effect_intents.policy_assertion_id": "assertions", "assertions.source_artifact_id": "artifacts"},
    )


def report(found: DataFrame) -> DataFrame:
    """Orphans per field, period of the referring row and reason."""
    return found.groupBy("ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_records"))
