"""Training-data queries that SQL can express, against their twins."""

import oracle
import pytest

from panelkit.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(oracle, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(oracle, "SQL", queries.SQL)
    assert oracle.compare(spark, oracle.connect(FOLDER), name, FOLDER) == []
