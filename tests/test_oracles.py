"""Every query of the event-market operators against its SQL twin, over the smallest tables."""

from __future__ import annotations

import pytest

from tallyspark.plans import audit_queries, evidence_queries, extra_queries, feature_queries, further_queries, model_queries, more_queries, raw_queries, state_queries, stream_queries, summary_queries  # noqa: F401
from tallyspark.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        compare(df, ORACLES[name], con)
    else:
        df.collect()
