"""A local Spark session for the tests and the benchmark.

On a cluster the session comes from the caller, with its own settings; nothing
in this package reads or changes them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str, cpus: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
