"""Tables that a plan reads more than once: written to the folder that all executors share, then reread.

The folder is the session's ``spark.checkpoint.dir``. Only on a local master a temporary one is made where that is unset.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """df as Parquet in the shared folder, read by a schema of its own if one is given; removed when the driver's Python ends."""
    path = f"{folder(df.sparkSession)}/tidemill-{name}-{uuid.uuid4().hex}"
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
