"""Lead-lag queries over users with so few events that a side of their pairs never changes, against the SQL twins."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tallyspark.operators import grid
from tests import oracle

QUERIES = ["h07_cross_correlation", "h09_peak", "h12_clock_basis", "h13_lead_lag_rows", "h14_market_summary", "h24_resolution_levels"]


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """sf0.001 with the events dealt to 200 users."""
    folder = tmp_path_factory.mktemp("sparse")
    con = oracle.connect("/root/testdata/sf0.001")
    con.execute(f"COPY (SELECT event_id, ts, event_id % 200 AS user_id, event_type, value, props FROM events) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_sides_that_never_change(spark, sparse, name):
    oracle.compare(entry.queries()[name](spark, sparse), entry.oracle_sql()[name], oracle.connect(sparse))


def test_correlation_of_constant_sides_is_null(spark):
    price = {"flat": [5.0] * 6, "grows": [2.0**i for i in range(6)], "moves": [1.0, 2.0, 3.0, 2.0, 5.0, 4.0], "short": [1.0, 2.0, 2.5], "gaps": [1.0, 2.0, 3.0, 2.0, 5.0, 4.0]}
    mid = [0.5, 0.25, 0.75, 0.5, 0.625, 0.125]
    rows = [(k, i + 3 * (k == "gaps" and i > 2), p, mid[i]) for k, ps in price.items() for i, p in enumerate(ps)]
    out = {(r["k"], r["lag"]): (r["n"], r["corr"]) for r in grid.cross_correlation(spark.createDataFrame(rows, "k string, i int, price double, mid double"), "k", [-1, 0, 1]).collect()}
    assert {x for x in out if out[x][1] is not None} == {(k, x) for k in ("moves", "gaps") for x in (-1, 0, 1)}
    assert [out[("flat", x)][0] for x in (-1, 0, 1)] == [4, 5, 4] and [out[("short", x)][0] for x in (-1, 0, 1)] == [1, 2, 1]
    # steps 3 to 5 are missing: a lag counts steps, not rows
    assert [out[("gaps", x)][0] for x in (-1, 0, 1)] == [3, 5, 3]
