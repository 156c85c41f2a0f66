"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local run gets a temporary folder, and a cluster an error, as executors share no local folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scratch")
        sc.setCheckpointDir(base)
    return base


#: Rows that Python gets at once where rows are large, so that batches stay within some MB.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Shuffle files of a query go when it ends, not only when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches(spark: SparkSession, rows: int):
    """What runs within sends at most so many rows to Python at once."""
    return _set(spark, {BATCH: str(rows)})


#: Rows that a task gets of what is dealt by keys, about.
ROWS = 250_000


def shares(spark: SparkSession, rows: int) -> int:
    """Parts for so many rows, so that what a task holds doesn't grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def dealt(spark: SparkSession, rows: int):
    """What runs within deals rows by keys to shares(rows) tasks, if there are more rows than one takes."""
    return _set(spark, {} if rows <= ROWS else {"spark.sql.shuffle.partitions": str(shares(spark, rows)), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one; what is written there goes when the session's process ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: The paths of kept tables.
_KEPT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def keep(df: DataFrame, name: str, batch: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to a new table of the shared folder, parted by the last columns if they are named, and reads it back.

    What was shuffled for it goes at once, the table when the session's process ends, if drop() doesn't take it before.
    """
    spark = df.sparkSession
    path = place(spark, name)
    with _set(spark, {BATCH: str(batch), CLEANUP: "true"}):
        df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _KEPT[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Takes tables that keep() gave away, if nothing reads them any more, so that they don't lie beside those that follow."""
    for df in tables:
        _remove(df.sparkSession, _KEPT.pop(df))


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a kept table has at most so many rows, and so may be broadcast."""
    return df.count() <= rows


def near(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A kept table to be broadcast if it has at most so many rows, and as it is beyond."""
    return F.broadcast(df) if small(df, rows) else df
