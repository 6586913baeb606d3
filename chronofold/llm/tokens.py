"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (tiktoken ranks) and the pattern that belongs to it; both are parameters.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """key, the columns of keep, n_tokens: of the whole text; 0 for null or empty text.
    The vocabulary (a few MB) is read on the driver and sent to each executor once."""
    from pyspark.sql.types import LongType, StructField, StructType

    cols = df.select(key, *keep)
    schema = StructType([*cols.schema.fields, StructField("n_tokens", LongType())])
    with open(vocabulary, "rb") as f:
        lines = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return df.select(key, *keep, F.col(text).cast("string").alias("text_to_count_")).mapInArrow(run, schema)
