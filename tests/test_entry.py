"""The driver contract, and every registered query against its SQL in DuckDB."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tallyframe.sources.tables import SCHEMAS

TESTDATA = "/root/testdata"


def oracle_rows(sf_dir, sql):
    db = duckdb.connect()
    for table in SCHEMAS:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = db.execute(sql)
    return [c[0] for c in result.description], sorted(result.fetchall())


def test_entry_returns_rows_with_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.dtypes == [("n_name", "string"), ("revenue", "double"), ("n_items", "bigint")]
    assert df.count() > 0


#: The queries of the library itself; those of optional parts are tested with these parts.
OWN = ["revenue_by_nation"]


def test_every_query_of_the_library_has_sql():
    assert set(OWN) <= contract.queries().keys() & contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize(
    "deleted",
    [("tallyframe/llm",), ("corpus_pipeline.py",), ("tallyframe/llm", "corpus_pipeline.py")],
    ids=["operators", "pipeline", "both"],
)
def test_optional_parts_may_be_deleted(deleted, tmp_path):
    """Run in a copy of the repository in which the parts are really not there."""
    root = Path(contract.__file__).resolve().parent
    copy = tmp_path / "copy"
    skip = {root / part for part in deleted}
    copy.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if root / name not in skip:
            shutil.copy(root / name, copy / name)
    shutil.copytree(
        root / "tallyframe",
        copy / "tallyframe",
        ignore=lambda folder, names: {n for n in names if n == "__pycache__" or Path(folder) / n in skip},
    )
    code = "import __spark_entry__ as e; print(*e.queries(), '|', *e.oracle_sql())"
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=False
    )
    assert run.returncode == 0, run.stderr
    names, sql = (x.split() for x in run.stdout.split("|"))
    there = (root / "tallyframe/llm").is_dir() and "tallyframe/llm" not in deleted
    assert [n for n in names if n in OWN] == [n for n in sql if n in OWN] == OWN
    assert there == any(n.startswith("op") for n in names)
    if "corpus_pipeline.py" in deleted or not there:
        assert "pipeline" not in names


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, name, sf):
    sf_dir = f"{TESTDATA}/sf{sf}"
    df = contract.queries()[name](spark, sf_dir)
    columns, rows = oracle_rows(sf_dir, contract.oracle_sql()[name])
    assert df.columns == columns
    assert sorted(tuple(r) for r in df.collect()) == rows


@pytest.mark.parametrize("table", list(SCHEMAS))
def test_declared_schema_is_the_schema_of_the_files(spark, table):
    path = f"{TESTDATA}/sf0.01/{table}.parquet"
    declared = spark.read.schema(SCHEMAS[table]).parquet(path)
    assert declared.dtypes == spark.read.parquet(path).dtypes
