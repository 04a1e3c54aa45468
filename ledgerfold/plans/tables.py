"""Parcels, listings, signals, runs and sales over the supplied tables, and the same as SQL for the checks."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.storage import shared_folder  # noqa: F401  used by the queries

#: Reference dates; library code never asks for the current one.
AS_OF = datetime.date(1998, 6, 15)
NOW = datetime.datetime(2024, 1, 31)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c, mapping: dict, default=None):
    out = F.lit(default)
    for k, v in reversed(mapping.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


MARKETS = {"AFRICA": "shelby", "AMERICA": "cuyahoga", "ASIA": "summit", "EUROPE": "wayne", "MIDDLE EAST": "lucas"}
TYPES = {"1": "mortgage_foreclosure", "2": "tax_deed", "3": "probate", "4": "tax_delinquent"}
STATUSES = {"O": "active", "P": "not_listed", "F": "expired"}
EVENTS = {"view": "code_violation", "signup": "eviction", "purchase": "tax_delinquent", "error": "blight_violation", "click": "probate"}


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (raw(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    market = _case(F.col("r_name"), MARKETS)
    return joined.select(
        F.lpad(k.cast("string"), 7, "0").alias("parcel_number"), market.alias("market"), _case(market, {"shelby": "TN", "wayne": "MI"}, "OH").alias("property_state"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, F.concat(F.lit("ACME HOMES "), k.cast("string"), F.lit(" LLC"))).otherwise(F.col("c_name")).alias("owner_name"),
        F.when(k % 11 != 0, F.concat((100 + k % 800).cast("string"), F.lit(" "), F.col("n_name"), F.lit(" ST"))).alias("situs_address"),
        F.col("n_name").alias("property_city"), F.col("c_acctbal").cast("decimal(18,2)").alias("current_tax_balance"), F.col("c_mktsegment").alias("property_class"),
        F.when(k % 4 != 0, (k % 12).cast("int")).alias("tax_years_delinquent"), k.alias("custkey"),
    )


PARCELS_SQL = """
parcels as (
  select lpad(c_custkey::varchar, 7, '0') parcel_number, m.market, case m.market when 'shelby' then 'TN' when 'wayne' then 'MI' else 'OH' end property_state,
    case when c_custkey % 10 = 0 then null when c_custkey % 10 = 1 then 'ACME HOMES ' || c_custkey || ' LLC' else c_name end owner_name,
    case when c_custkey % 11 <> 0 then (100 + c_custkey % 800) || ' ' || n_name || ' ST' end situs_address, n_name property_city, c_acctbal::decimal(18,2) current_tax_balance,
    c_mktsegment property_class, case when c_custkey % 4 <> 0 then (c_custkey % 12)::int end tax_years_delinquent, c_custkey custkey
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  join (values ('AFRICA', 'shelby'), ('AMERICA', 'cuyahoga'), ('ASIA', 'summit'), ('EUROPE', 'wayne'), ('MIDDLE EAST', 'lucas')) m(r, market) on r_name = m.r)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = raw(spark, sf_dir, "orders"), parcels(spark, sf_dir)
    k = F.col("o_orderkey")
    kind = _case(F.substring("o_orderpriority", 1, 1), TYPES)
    day = F.to_date("o_orderdate")
    return o.join(p, o.o_custkey == p.custkey).select(
        F.concat(F.lit("L"), F.lpad(k.cast("string"), 10, "0")).alias("id"), F.concat(F.lit("site_"), (k % 7).cast("string")).alias("source_site"), "market",
        F.when(k % 13 != 0, F.col("parcel_number")).alias("parcel_number"), F.when(k % 17 != 0, F.concat((100 + F.col("o_custkey") % 800).cast("string"), F.lit(" "), F.col("property_city"), F.lit(" STREET"))).alias("property_address"),
        "property_city", "property_state", kind.alias("signal_type"), _case(F.col("o_orderstatus"), STATUSES).alias("status"), F.when(k % 19 != 0, day).alias("sale_date"),
        F.date_sub(day, 30).alias("first_seen"), F.date_add(day, (k % 40).cast("int")).alias("last_seen"), F.col("o_totalprice").cast("decimal(18,2)").alias("opening_bid_usd"),
        F.when(k % 23 == 0, F.lit(None)).when(kind == "probate", F.concat((1990 + k % 12).cast("string"), F.lit("EST"), F.lpad((k % 1000).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("CV-"), (F.col("o_custkey") % 500).cast("string"))).alias("case_number"),
        _case(k % 5, {0: "confirmed", 1: "probable", 2: "review", 3: "unverified"}).alias("match_confidence"), _case(k % 6, {0: "CLOSED - CLOSED", 1: "Open"}).alias("case_status"),
        F.when(kind == "tax_deed", _case(k % 4, {0: "pending", 1: "redeemed", 3: "final"})).alias("redemption_status"), F.when(k % 5 == 0, "distress_signal").otherwise("buy_now").alias("distress_stage"), k.alias("orderkey"),
    )


LISTINGS_SQL = """
listings as (
  select 'L' || lpad(o_orderkey::varchar, 10, '0') id, 'site_' || (o_orderkey % 7) source_site, market, case when o_orderkey % 13 <> 0 then parcel_number end parcel_number,
    case when o_orderkey % 17 <> 0 then (100 + o_custkey % 800) || ' ' || property_city || ' STREET' end property_address, property_city, property_state, t.kind signal_type,
    case o_orderstatus when 'O' then 'active' when 'P' then 'not_listed' when 'F' then 'expired' end status, case when o_orderkey % 19 <> 0 then o_orderdate::date end sale_date,
    (o_orderdate::date - 30)::date first_seen, (o_orderdate::date + (o_orderkey % 40)::int)::date last_seen, o_totalprice::decimal(18,2) opening_bid_usd,
    case when o_orderkey % 23 = 0 then null when t.kind = 'probate' then (1990 + o_orderkey % 12) || 'EST' || lpad((o_orderkey % 1000)::varchar, 4, '0') else 'CV-' || (o_custkey % 500) end case_number,
    case o_orderkey % 5 when 0 then 'confirmed' when 1 then 'probable' when 2 then 'review' when 3 then 'unverified' end match_confidence,
    case o_orderkey % 6 when 0 then 'CLOSED - CLOSED' when 1 then 'Open' end case_status,
    case when t.kind = 'tax_deed' then case o_orderkey % 4 when 0 then 'pending' when 1 then 'redeemed' when 3 then 'final' end end redemption_status,
    case when o_orderkey % 5 = 0 then 'distress_signal' else 'buy_now' end distress_stage, o_orderkey orderkey
  from orders join parcels on o_custkey = custkey
  left join (values ('1', 'mortgage_foreclosure'), ('2', 'tax_deed'), ('3', 'probate'), ('4', 'tax_delinquent')) t(d, kind) on t.d = left(o_orderpriority, 1))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = raw(spark, sf_dir, "events"), parcels(spark, sf_dir).select("custkey", "market")
    return e.join(p, e.user_id == p.custkey).select(
        F.col("event_id").alias("id"), F.lpad(F.col("user_id").cast("string"), 7, "0").alias("parcel_number"), "market", _case(F.col("event_type"), EVENTS).alias("signal_type"),
        F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("ts").alias("observed_at"), (F.col("ts") + F.make_dt_interval((F.col("event_id") % 5).cast("int"))).alias("last_seen_at"),
        F.col("props").alias("payload"), (F.col("value") * 20).cast("decimal(18,2)").alias("balance"),
    )


SIGNALS_SQL = """
signals as (
  select event_id id, lpad(user_id::varchar, 7, '0') parcel_number, market, case event_type when 'view' then 'code_violation' when 'signup' then 'eviction' when 'purchase' then 'tax_delinquent' when 'error' then 'blight_violation' when 'click' then 'probate' end signal_type,
    'src' || (user_id % 3) source, ts observed_at, ts + to_days((event_id % 5)::int) last_seen_at, props payload, (value * 20)::decimal(18,2) balance
  from events join parcels on user_id = custkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).groupBy("source", "signal_type", F.to_date("observed_at").alias("day"))
    out = s.agg(F.count("*").alias("found"), F.min("observed_at").alias("started_at"), F.count_distinct("parcel_number").alias("active"))
    return out.select(F.concat_ws(":", "source", "signal_type").alias("source_site"), "day", "started_at", F.when(F.dayofmonth("day") % 11 == 0, F.lit(0)).otherwise(F.col("found")).cast("long").alias("found"), "active", F.when(F.dayofmonth("day") % 13 == 0, "error").otherwise("success").alias("status"))


RUNS_SQL = """
runs as (
  select source || ':' || signal_type source_site, observed_at::date as day, min(observed_at) started_at, case when dayofmonth(observed_at::date) % 11 = 0 then 0 else count(*) end::bigint found,
    count(distinct parcel_number) active, case when dayofmonth(observed_at::date) % 13 = 0 then 'error' else 'success' end status
  from signals group by source, signal_type, observed_at::date)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), raw(spark, sf_dir, "lineitem")
    return i.join(o, i.l_orderkey == o.o_orderkey).select(F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("parcel_number"), F.to_date("l_shipdate").alias("sale_date"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))


SALES_SQL = """
sales as (select lpad(o_custkey::varchar, 7, '0') parcel_number, l_shipdate::date sale_date, l_extendedprice::decimal(18,2) price from lineitem join orders on l_orderkey = o_orderkey)"""

PRELUDE = "with " + ",".join([PARCELS_SQL, LISTINGS_SQL, SIGNALS_SQL, RUNS_SQL, SALES_SQL])
