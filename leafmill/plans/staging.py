"""Cutting lineage and size-checked broadcasts, shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}

#: A side of a join is broadcast only if its Parquet size is at most this many bytes, and its rows at most so many: columns of
#: few distinct values take many times their Parquet size in memory.
BROADCAST_BYTES, BROADCAST_ROWS = 8_000_000, 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset a temporary one, which only a local session may have."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="leafmill_")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return "file://" + _OWN_DIR[app]


def run_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/leafmill-{app}"
    if app not in _CLEARED:
        _CLEARED.add(app)
        atexit.register(_delete, spark, path)
    return path


_CLEARED: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session has ended, and with it the way to the folder
        pass


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and executors may be lost."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    return out


def staged_bytes(df: DataFrame) -> int:
    """Bytes of a table made by ``stage``."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._leafmill_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength()


def range_partitions(staged: DataFrame, bytes_each: int) -> int:
    """How many partitions of about ``bytes_each`` a staged table gives, at least the session's shuffle partitions."""
    few = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(few, 64), -(-staged_bytes(staged) // bytes_each))


def staged_within(staged: DataFrame, limit: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table made by ``stage`` or ``small`` has at most ``limit`` bytes and ``rows`` rows; that of a few bytes has not more than these."""
    size = staged_bytes(staged)
    return size <= limit and (size <= 64_000 or staged.count() <= rows)


def small(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` staged; hinted for broadcast if it is within ``limit`` bytes and ``rows`` rows, else left to a shuffled join."""
    staged = stage(df)
    if not staged_within(staged, limit, rows):
        return staged
    out = F.broadcast(staged)
    out._leafmill_path = staged._leafmill_path
    return out


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the smallest hash of ``key``, to fit a model on.

    A bound on the hash, set by the table's count, keeps all but about twice as many from leaving their tasks.
    """
    n = max(df.count(), 1)
    hashed = df.withColumn("_h", F.xxhash64(*key))
    if n > 2 * rows:
        hashed = hashed.where(F.col("_h") < int(-(2**63) + 2**64 * (2.0 * rows / n)))
    return hashed.orderBy("_h").limit(rows).drop("_h")
