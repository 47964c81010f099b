"""Tables that cut lineage: written once to the folder that all executors share, then reread.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder is made and set, but only
for a local master: the executors of a cluster would not see it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; removed when the driver's Python ends."""
    path = f"{folder(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def table(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder, partitioned by the columns `by`, and returns a DataFrame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def discard(made: DataFrame) -> None:
    """Removes what table() wrote, when nothing reads it any more."""
    _remove(made.sparkSession, made._stored_at)
    _written.remove((made.sparkSession, made._stored_at))


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Tables that are written inside get batches of about `size` bytes at most into Python, for rows of some megabytes each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def set_small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """The same for all that this session runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sets with the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            _remove(spark, path)
