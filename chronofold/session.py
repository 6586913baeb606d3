"""Session settings and the scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, SparkSession] = {}


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on a local master may it
    be unset; a local folder is made then. Elsewhere executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chronofold-")
    return _LOCAL[app]


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the shared one that goes when the driver ends."""
    root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    _MADE[root] = spark
    return root


def release(spark: SparkSession) -> None:
    """Deletes what the session's queries wrote to the shared folder so far, for sessions
    that live long. Results that were not read or written yet are lost."""
    for root in [r for r, s in _MADE.items() if s is spark]:
        _delete(spark, root)
        del _MADE[root]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder. A written table cuts the lineage and
    survives the loss of executors; loops drop the rounds they no longer read.
    What is left goes with release() or when the driver ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = scratch_folder(spark, what)
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)


@atexit.register
def _clean() -> None:
    for root, spark in list(_MADE.items()):
        try:
            _delete(spark, root)
        except Exception:  # the session may be gone; its folder then goes with it
            pass
