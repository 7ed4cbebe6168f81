"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only a local session may go
without it, as in tests; a cluster session without it is an error, because a
machine-local folder would lose what other executors wrote.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tallyframe-")


_made: list[str] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A path that no other run uses; nothing is created yet."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_stored(spark: SparkSession) -> int:
    """Removes the tables and files that this driver has stored so far; returns how many there were.

    For the end of a job, when its results are written elsewhere: results that still read
    stored tables can't be read afterwards.
    """
    hadoop, removed = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = hadoop.Path(_made[-1])
        removed += path.getFileSystem(conf).delete(path, True)
        _made.pop()
    return removed


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    It cuts the lineage: later readers reread files instead of running ``df`` again,
    also after executors are lost.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
