"""Every registered query of the subpackage, and those with SQL against DuckDB."""

import pytest

import corpus_pipeline
from tallyframe.llm import registry

from tests.llm.helpers import DATA, sql_rows

TABLES = ("documents", "labels", "conversations")


def test_each_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert list(corpus_pipeline.QUERIES) == ["pipeline"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_matches_its_sql(spark, name, sf):
    df = registry.QUERIES[name](spark, f"{DATA}/sf{sf}")
    columns, result = sql_rows(f"{DATA}/sf{sf}", registry.ORACLES[name], TABLES)
    assert sorted(df.columns) == columns
    names = [c[0] for c in result.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(result.fetchall(), key=key)
