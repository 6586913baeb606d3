"""Read-only SQL: one SELECT, EXPLAIN, DESCRIBE or SHOW statement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_START = re.compile(r"\s*(select|explain|describe|desc|show)\b", re.I)
_TEXTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


_STRINGS = re.compile(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/", re.S)
#: Calls into the JVM, and tables named by format and path.
_CALLS = re.compile(r"\b(java_method|reflect|try_reflect)\s*\(", re.I)
_PATHS = re.compile(r"\b(parquet|orc|csv|json|text|avro|binaryfile|delta|xml)\s*\.\s*`", re.I)


class UnsafeQuery(ValueError):
    pass


def read_sql(spark: SparkSession, text: str) -> DataFrame:
    """The result of a read-only statement; anything else raises UnsafeQuery."""
    bare = _TEXTS.sub(" ", text).strip()
    if ";" in bare.rstrip("; \n\t"):
        raise UnsafeQuery("one statement only")
    if not _START.match(bare):
        raise UnsafeQuery("only SELECT, EXPLAIN, DESCRIBE and SHOW")
    if _CALLS.search(bare) or _PATHS.search(_STRINGS.sub(" ", text)):
        raise UnsafeQuery("no calls into the JVM and no paths")
    return spark.sql(text.rstrip().rstrip(";"))
