"""The queries that have SQL against it."""

from __future__ import annotations

import pytest
from checks.compare import database, rows
from llm.conftest import SMALL

from wardline.llm.oracle import ORACLE
from wardline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    frame = QUERIES[name](spark, SMALL)
    relation = database(SMALL).sql(ORACLE[name])
    assert sorted(relation.columns) == sorted(frame.columns)
    mine = rows([tuple(r) for r in frame.collect()], frame.columns)
    assert mine == rows(relation.fetchall(), relation.columns)
