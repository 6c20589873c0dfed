"""Every query of the drift operators that SQL can express against its SQL; the others have tests of their own."""

from __future__ import annotations

import pytest

from tidewatch.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_what_sql_cannot_express():
    assert set(QUERIES) - set(ORACLES) == {"logistic_predictions", "stream_monitor", "stream_series"}  # tests/test_operators.py
