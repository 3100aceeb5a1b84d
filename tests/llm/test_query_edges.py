"""Registered queries of the training-data operators over empty, all-null and column-clashing tables."""

import edge_tables
import pytest

from strandloom.llm.queries import R


@pytest.fixture(scope="module", params=["empty", "nulls", "clash"])
def variant(request, tmp_path_factory):
    return request.param, edge_tables.make(tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query_survives(spark, variant, name):
    kind, d = variant
    rows = R.queries[name](spark, d).collect()
    if kind == "clash":
        assert len(rows) == len(R.queries[name](spark, str(edge_tables.SOURCE)).collect())
