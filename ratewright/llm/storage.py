"""Written tables in the folder that driver and executors share.

Iterative operators cut their lineage here: a table is written once, read back
by its files, and so survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a single machine a temporary one where that is unset, on a cluster an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ratewright-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: Where the tables are that a frame was read back from.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that :func:`materialize` gave, once nothing reads them any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop(df))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
