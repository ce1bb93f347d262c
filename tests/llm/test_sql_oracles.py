"""Queries that SQL can express, against their DuckDB SQL on the smallest tables."""

import pytest
from conftest import SF_SMALL

from tuneshelf.llm.queries import LLM_ORACLES, LLM_QUERIES


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


def test_every_dealt_operator_is_registered():
    numbers = {int(n.split("_")[0][2:]) for n in LLM_QUERIES if n != "pipeline"}
    assert numbers == set(range(1, 14)) and "pipeline" in LLM_QUERIES and set(LLM_ORACLES) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = LLM_QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(LLM_ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, res.fetchall())
