"""What shows only beyond the keys and rows of the supplied tables."""

import datetime

import pytest

from ledgerfold.plans import registry


@pytest.fixture
def duck():
    import duckdb

    return duckdb.connect()


def against_sql(spark, duck, name, folder, **tables):
    """Rows of the query and of its SQL over these tables (DataFrames by name)."""
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"file://{folder}/{t}.parquet")
        duck.sql(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, f"file://{folder}")
    want = duck.sql(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
    return sorted((tuple(r) for r in got.collect()), key=repr), sorted(want, key=repr)


def test_the_last_zip_is_absent_too(spark, duck, tmp_path):
    customer = spark.createDataFrame([(k, k % 25) for k in (7, 8, 99_998, 99_999, 100_000, 199_999)], "c_custkey long, c_nationkey int")
    got, want = against_sql(spark, duck, "city_zip", tmp_path, customer=customer)
    assert got == want
    assert (99_999, "Nation_24", "99999", True) in got


def test_ages_by_parts_of_a_second(spark, duck, tmp_path):
    """A fraction of a second before the minute is full; balances that round to nothing, and none."""
    now = datetime.datetime(2024, 1, 31)
    ago = [datetime.timedelta(minutes=m) - datetime.timedelta(microseconds=u) for m in (1, 60, 1440, 17 * 1440) for u in (0, 1, 999_999, 1_000_000)] + [datetime.timedelta(seconds=-1)]
    values = [0.025, -0.01, None, 0.075, 61.725, 0.125]
    rows = [(5 * i, 1, "view", now - a, "{}", values[i % len(values)]) for i, a in enumerate(ago)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, props string, value double")
    others = {
        "customer": spark.createDataFrame([(1, "c", 0, 1.0, "X")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"), "region": spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string"),
        "orders": spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": spark.createDataFrame([], "l_orderkey long, l_shipdate timestamp_ntz, l_extendedprice double"),
    }
    got, want = against_sql(spark, duck, "relative_ages", tmp_path, events=events, **others)
    assert got == want
    assert (5, "just now", "$0") in got
