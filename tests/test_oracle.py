"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from wayfold.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert canonical(rows) == canonical(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_scenario_reaches_the_reasons(spark):
    """The decision query meets every reason that its rows can bring about."""
    seen = {r.reason for r in QUERIES["decision_counts"](spark, "/root/testdata/sf0.01").collect()}
    for reason in ("first_fix_good", "weak_signal_stage1", "impossible_speed", "transport_suspected", "transport_confirmed", "transport_recovery", "gap_recovery", "moving_good_fix", "stationary_accel_supported_jitter", "stationary_keepalive",
                   "non_positive_delta_time", "rest_candidate", "mock_location", "provider_not_gps", "zero_coordinate", "invalid_accuracy", "accuracy_too_large", "location_too_old", "missing_elapsed_realtime"):
        assert reason in seen, reason
