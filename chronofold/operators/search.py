"""Hybrid retrieval: lexical, vector and graph-distance score, top k.

Text and vector scores are column expressions over one scan; only the k best
leave it (TakeOrderedAndProject). The graph part joins the reached entities of
the start, which the depth bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import scalars as S

# Fixed value: characters of a source's content that count, as in the reference.
SOURCE_CHARACTERS = 4_096


def text_of(df: DataFrame) -> Column:
    """The text an assertion is found by: ids with blanks for underscores, object, kind,
    perspective, and the text of its source if with_sources added it."""
    source = ["source_text"] if "source_text" in df.columns else []
    return F.concat_ws(" ", "subject_entity_id", F.replace(F.col("predicate"), F.lit("_"), F.lit(" ")), S.typed_text("object_json"), F.replace(F.col("kind"), F.lit("_"), F.lit(" ")), "perspective", *source)


def with_sources(df: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds source_text: identity and first 4,096 characters of the source artifact, null
    unless it is active in all its copies; of differing copies the smallest holds."""
    text = F.concat_ws(" ", "source_identity", F.substring("content", 1, SOURCE_CHARACTERS))
    active = artifacts.groupBy("tenant_id", F.col("artifact_id").alias("source_artifact_id")).agg(F.min(text).alias("source_text"), F.min(F.col("status") == "active").alias("active_")).where("active_").drop("active_")
    return df.join(active, ["tenant_id", "source_artifact_id"], "left")


def query_tokens(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1]


def scores(df: DataFrame, text: Column | str, query: str) -> DataFrame:
    """Adds lexical and vector scores of the text against the query."""
    words = query_tokens(query)
    q = F.array(*(F.lit(w) for w in words)).cast("array<string>")
    both = S.let(S.tokens(text), lambda t: F.struct(S.lexical_score(q, t).alias("lexical"), F.greatest(F.lit(0.0), S.hash_cosine(t, S.hash_vector(words))).alias("vector")))
    return df.withColumn("scores_", both).withColumns({"lexical": F.col("scores_.lexical"), "vector": F.col("scores_.vector")}).drop("scores_")


def hybrid(candidates: DataFrame, query: str, limit: int = 20, reached: DataFrame | None = None, text: Column | str | None = None) -> DataFrame:
    """tenant_id, assertion_id, lexical, vector, distance, score: the best candidates.

    reached (tenant_id, node, distance): only assertions whose subject or object it
    holds stay, and nearer ones score higher. A null or empty text scores 0, and a
    score of 0 is no hit. limit is clamped to 1..100."""
    df = candidates.dropDuplicates(["tenant_id", "assertion_id"])
    df = scores(df, text if text is not None else text_of(df), query)
    boost = F.lit(0.0)
    if reached is not None:
        ends = df.select("tenant_id", "assertion_id", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("node")).where("node is not null")
        near = ends.join(reached.select("tenant_id", "node", "distance"), ["tenant_id", "node"]).groupBy("tenant_id", "assertion_id").agg(F.min("distance").alias("distance"))
        df = df.join(near, ["tenant_id", "assertion_id"])
        boost = S.GRAPH_WEIGHT / (1 + F.col("distance"))
    else:
        df = df.withColumn("distance", F.lit(None).cast("int"))
    score = S.round6(S.LEXICAL_WEIGHT * F.col("lexical") + S.VECTOR_WEIGHT * F.col("vector") + boost)
    out = df.select("tenant_id", "assertion_id", S.round6(F.col("lexical")).alias("lexical"), S.round6(F.col("vector")).alias("vector"), "distance", score.alias("score"))
    return out.where("lexical > 0 or vector > 0").orderBy(F.desc("score"), "assertion_id").limit(max(1, min(100, limit)))


def two_branches(candidates: DataFrame, words: list[str], vector: list[float], limit: int = 20, candidate_limit: int = 200) -> DataFrame:
    """tenant_id, assertion_id, lexical, vector, score: the best of the candidate_limit
    (1..5,000) nearest stored vectors and as many texts that hold every word.

    Both branches keep their best rows only, so no score of the rest is sorted or moved.
    A missing or unusable vector scores 0 and is no candidate of the first branch; a null
    text none of the second. Repeated rows count once. Equal scores go by id."""
    n = max(1, min(5_000, candidate_limit))
    q = F.array(*(F.lit(w) for w in dict.fromkeys(words))).cast("array<string>")
    v = F.from_json("embedding_json", "array<double>")
    rows = candidates.groupBy("tenant_id", "assertion_id").agg(F.min("search_text").alias("t"), F.min("embedding_json").alias("embedding_json"))
    rows = rows.withColumn("v_", v).withColumn("lexical", F.coalesce(F.size(F.array_intersect(q, S.tokens("t"))) / F.lit(float(max(1, len(dict.fromkeys(words))))), F.lit(0.0)))
    fit = (F.size("v_") == len(vector)) & F.forall("v_", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (S.norm(F.col("v_")) > 0)
    rows = rows.select("tenant_id", "assertion_id", "lexical", F.when(fit, S.cosine(F.col("v_"), F.array(*(F.lit(float(x)) for x in vector)))).alias("cosine"))
    near = rows.where("cosine is not null").orderBy(F.desc(S.round6(F.col("cosine"))), "assertion_id").limit(n)
    said = rows.where("lexical = 1").orderBy("assertion_id").limit(n)
    hit = near.union(said).distinct().withColumn("v_", F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)))
    out = hit.select("tenant_id", "assertion_id", S.round6(F.col("lexical")).alias("lexical"), S.round6(F.col("v_")).alias("vector"), S.round6(S.LEXICAL_WEIGHT * F.col("lexical") + S.VECTOR_WEIGHT * F.col("v_")).alias("score"))
    return out.where("lexical > 0 or vector > 0").orderBy(F.desc("score"), "assertion_id").limit(max(1, min(100, limit)))


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, key: str, column: str, k: int, rows_per_block: int = 200_000, queries_per_block: int = 4_000) -> DataFrame:
    """(key_query, key, cosine): the k vectors of largest cosine to each query, exactly.

    Vectors and queries are laid out in blocks, and each pair of blocks is one matrix
    product that keeps k rows a query, so what is moved is the blocks and k rows a query
    and block. A null key or vector, one of another length than most or without length is
    left out; a repeated key counts once; equal cosines go by key. Empty tables give none."""
    clean = lambda df: df.select(F.col(key).alias("key_"), F.col(column).cast("array<double>").alias("v_")).dropna().dropDuplicates(["key_"])
    q, v = clean(queries), clean(vectors)
    n_q, n_v = (max(1, -(-df.count() // per)) for df, per in ((q, queries_per_block), (v, rows_per_block)))
    place = lambda n: F.pmod(F.xxhash64("key_"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = q.select(place(n_q).alias("qb_"), every(n_v).alias("vb_"), F.lit(False).alias("row_"), "key_", "v_").unionByName(v.select(every(n_q).alias("qb_"), place(n_v).alias("vb_"), F.lit(True).alias("row_"), "key_", "v_"))
    schema = StructType([StructField(f"{key}_query", q.schema["key_"].dataType), StructField(key, q.schema["key_"].dataType), StructField("cosine", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By pair of blocks, queries first; a block of queries is held, rows stream past."""
        at, ids, held, best = None, [], [], None

        def unit(lists: list) -> tuple[np.ndarray, np.ndarray]:
            fit = np.array([len(x) == len(lists[0]) and None not in x and any(x) for x in lists])
            x = np.array([x for x, ok in zip(lists, fit) if ok], float).reshape(int(fit.sum()), -1)
            return fit, x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array([ids_[i] for i in best[0]], schema_q), pa.array(best[1].tolist(), schema_q), pa.array(best[2])], names=[f"{key}_query", key, "cosine"])

        ids_, m, schema_q = [], None, None
        for b in batches:
            qb, vb, is_row = b.column("qb_").to_numpy(), b.column("vb_").to_numpy(), b.column("row_").to_numpy(zero_copy_only=False)
            schema_q = b.column("key_").type
            cuts = [0, *(np.flatnonzero((np.diff(qb) != 0) | (np.diff(vb) != 0) | (is_row[1:] != is_row[:-1])) + 1).tolist(), len(qb)]
            for a, z in zip(cuts, cuts[1:]):
                if at != (qb[a], vb[a]):
                    yield from done()
                    at, ids, held, best, m = (qb[a], vb[a]), [], [], None, None
                part = b.slice(a, z - a)
                keys, lists = part.column("key_").to_pylist(), part.column("v_").to_pylist()
                if not is_row[a]:
                    ids += keys
                    held += lists
                    continue
                if not ids:
                    continue
                if m is None:
                    fit, m = unit(held)
                    ids_ = [i for i, ok in zip(ids, fit) if ok]
                    best = np.zeros(0, int), np.zeros(0, object), np.zeros(0)
                fit, x = unit(lists)
                if not len(x) or not len(m) or x.shape[1] != m.shape[1]:
                    continue
                names = np.array([i for i, ok in zip(keys, fit) if ok], object)
                s = np.floor((m @ x.T) * 1e6 + 0.5) / 1e6
                keep = min(k, s.shape[1])
                low = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]  # ties at the end stay until ids decide
                i, j = np.nonzero(s >= low)
                who, near, cos = np.r_[best[0], i], np.r_[best[1], names[j]], np.r_[best[2], s[i, j]]
                order = np.lexsort((near.astype(type(near[0])), -cos, who))
                who, near, cos = who[order], near[order], cos[order]
                first = np.flatnonzero(np.r_[True, np.diff(who) > 0])
                rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
                best = who[rank < k], near[rank < k], cos[rank < k]
        yield from done()

    found = both.repartition("qb_", "vb_").sortWithinPartitions("qb_", "vb_", "row_").mapInArrow(run, schema)
    order = Window.partitionBy(f"{key}_query").orderBy(F.desc("cosine"), key)
    return found.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k).drop("rank_")
