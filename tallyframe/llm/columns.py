"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ASCII_UPPER = bytes(range(65, 91))
ASCII_LOWER = bytes(range(97, 123))
#: Lower-cases A-Z in UTF-8 and leaves every other byte alone.
LOWER_ASCII = bytes.maketrans(ASCII_UPPER, ASCII_LOWER)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their workers import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="tallyframe-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or with underscores behind it where a column has that name (in any case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def appended(
    df: DataFrame, added: str, make: Callable[[pa.RecordBatch], dict[str, pa.Array]]
) -> DataFrame:
    """``df`` with the columns of the DDL string ``added``, made batch by batch.

    Columns of ``df`` with one of those names (in any case) are replaced.
    """
    new = StructType.fromDDL(added)
    names = {f.name.lower() for f in new.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = StructType(kept + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [made[f.name] for f in new.fields],
                names=[f.name for f in schema.fields],
            )

    return df.mapInArrow(run, schema)
