"""Every query against its SQL, on the tables of sf0.01 (or of the folder in LEDGERFOLD_SF)."""

import datetime
import math
import os
from decimal import Decimal

import pytest

from ledgerfold.plans import registry

SF = os.environ.get("LEDGERFOLD_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(columns).collect())
    if sql := registry.ORACLES.get(name):
        want = duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
        assert sorted(duck.sql(sql).columns) == columns
        assert rows == sorted(repr(tuple(map(plain, r))) for r in want)
    assert len(rows) > 0 or name in ("run_collapse", "zero_yield", "collapse_guard", "quality_coverage", "listings_second_page", "surface_retire", "surface_refresh", "ambiguity_cap", "dedup_twin", "case_explosion", "quality_transfer", "quality_overlap", "surface_insert", "fuzzy_name_join", "quality_overmatch", "long_zero_runs", "owner_backfill", "sale_targets", "absence_retire", "cursor_runs_dry", "listings_rare_filters")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
