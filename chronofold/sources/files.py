"""File sources and sinks besides Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "requestId string, idempotencyKey string, principalId string, purpose string, tenantId string, operation string, input string"


def envelopes(spark: SparkSession, path: str, schema: str = ENVELOPE) -> DataFrame:
    """JSON request envelopes, one document a file or many; ill-formed ones come
    out with nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def stored_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, sha (hex SHA-256 of the bytes), length and modification time of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), "length", F.unix_micros("modificationTime").alias("modified_us"))


def unreferenced_files(files: DataFrame, artifacts: DataFrame, older_than_us: int) -> DataFrame:
    """Files no artifact refers to by its content hash, last changed before the time."""
    return files.where(F.col("modified_us") < older_than_us).join(artifacts.select(F.col("content_hash").alias("sha")).distinct(), "sha", "left_anti")


def damaged_files(files: DataFrame) -> DataFrame:
    """Files whose name is a hash that their bytes do not have."""
    return files.where(F.col("name").rlike("^[0-9a-f]{64}$") & (F.col("name") != F.col("sha")))


def sealed(content: Column | str, key_hex: str) -> Column:
    """AES-256-GCM of the content under a key of 64 hex digits."""
    return F.aes_encrypt(F.encode(content, "UTF-8"), F.unhex(F.lit(key_hex)), F.lit("GCM"))


def unsealed(content: Column | str, key_hex: str) -> Column:
    return F.decode(F.aes_decrypt(content, F.unhex(F.lit(key_hex)), F.lit("GCM")), "UTF-8")


def write_lines(lines: DataFrame, path: str) -> None:
    """A text sink, for instance of metrics lines."""
    lines.write.mode("overwrite").text(path)
