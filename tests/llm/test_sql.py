"""Queries of the subpackage that SQL can express."""

from __future__ import annotations

import pytest

from tidewatch.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(QUERIES[name](spark, sf_dir), ORACLES[name])
