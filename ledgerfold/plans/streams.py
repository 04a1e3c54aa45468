"""Queries of the paged scan, the walk over numbers, and leads that live as state. What lands is written by Spark from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.plans import tables
from ledgerfold.plans.registry import T, query
from ledgerfold.sources.paged import read_landed_pages
from ledgerfold.streaming import lifetimes, walk

PAGE = 500


def _land(t, name: str) -> str:
    return f"{tables.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def land_pages(rows: DataFrame, number: str, path: str, size: int = PAGE) -> None:
    """Pages of ``size`` rows in order of ``number`` (0, 1, 2 ...), as a feature service answers them, and the count page."""
    at = F.floor(F.col(number) / size)
    page = rows.groupBy(at.alias("page")).agg(F.array_sort(F.collect_list(F.struct(F.struct(number, *[c for c in rows.columns if c != number]).alias("attributes")))).alias("features"))
    page.select("page", F.to_json(F.struct("features")).alias("value")).repartition(4, "page").write.partitionBy("page").text(path)
    rows.agg(F.count("*").alias("count")).select(F.to_json(F.struct("count")).alias("value")).coalesce(1).write.text(f"{path}/count")


@query("select c_custkey as number, c_name as owner, c_acctbal::double as balance, c_mktsegment as class from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 100 and c_custkey > 20 and c_name like 'Customer%'", prelude=False)
def paged_scan(t):
    """Customers as pages of a feature service; all four conditions are pushed into the scan."""
    path = _land(t, "pages")
    land_pages(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"), "c_custkey", path)
    pages = read_landed_pages(t.spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", PAGE, item="attributes", pages_per_task=4)
    rows = pages.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") >= 100) & (F.col("c_custkey") > 20) & F.col("c_name").startswith("Customer"))
    return rows.select(F.col("c_custkey").alias("number"), F.col("c_name").alias("owner"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("class"))


_CASES = """with top as (select max(o_orderkey) as m from orders), cases as (select o_orderkey as number, o_orderstatus as kind, o_totalprice as amount from orders, top
  where o_orderkey % 40 < 30 and o_orderkey not between (4 * m) // 5 and (4 * m) // 5 + 40)"""


@query(_CASES + " select number, amount::double as amount from cases, top where kind = 'O' and number < (4 * m) // 5", prelude=False)
def id_walk_stream(t):
    """Orders as cases: gaps of ten numbers, and one of over forty at four fifths, where the walk ends. Only open cases are in scope, but all count as cases."""
    path, gap = _land(t, "cases"), 4 * t.orders.agg(F.max("o_orderkey")).first()[0] // 5
    cases = t.orders.filter((F.col("o_orderkey") % 40 < 30) & ~F.col("o_orderkey").between(gap, gap + 40))
    cases = cases.select(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").cast("double").alias("amount"), F.floor(F.col("o_orderkey") / 20_000).alias("bin"))
    cases.repartition(4, "bin").write.partitionBy("bin").parquet(f"{path}/landed")
    for _ in range(2):  # the second start finds nothing new
        stream = walk.walk_ids(t.spark, f"{path}/landed", "number long, amount double", f"{path}/progress/at", id="number", scope={"kind": "O"}, start=-1, misses=25, max_ids=10_000_000, bin_size=20_000)
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("number long, amount double").parquet(f"{path}/out")


#: Days that a lead lives without being seen; evictions are switched off.
LIFETIMES = {"code_violation": 4, "tax_delinquent": 21, "blight_violation": 45, "probate": 4}


@query(f"""
, s as (select parcel_number, market, signal_type, case signal_type when 'tax_delinquent' then 21 when 'blight_violation' then 45 when 'eviction' then null else 4 end as days, min(last_seen_at) as first_seen, max(last_seen_at) as last_seen, count(*) as sightings
  from signals where signal_type is not null group by all)
select parcel_number, market, signal_type, case when last_seen >= {T} - to_days(days) then 'active' else 'retired' end as status, first_seen, last_seen, sightings from s""")
def lead_lifetimes(t):
    """Signals in four deliveries that have nothing to do with their age, with a tick each; the last tick is the day of the report."""
    path = _land(t, "signals")
    day = lambda n: F.date_sub(t.now, 3 - n).cast("timestamp")
    rows = t.signals.filter("signal_type is not null").select("parcel_number", "market", "signal_type", "last_seen_at", F.lit(None).cast("timestamp").alias("clock"), (F.xxhash64("id") % 4).alias("n"))
    ticks = t.spark.range(4).select(*[F.lit(None).cast(k).alias(c) for c, k in rows.dtypes[:4]], day(F.col("id").cast("int")).alias("clock"), F.col("id").alias("n"))
    both = rows.withColumn("n", F.pmod("n", F.lit(4))).unionByName(ticks)
    schema = both.drop("n").schema
    for n in range(4):  # a run for each delivery, in order of its tick; a delivery is as many files as its rows need
        both.filter(F.col("n") == n).drop("n").write.mode("append").parquet(f"{path}/landed")
        stream = t.spark.readStream.schema(schema).parquet(f"{path}/landed")
        lifetimes.run_lifetimes(stream, LIFETIMES, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return lifetimes.current_leads(t.spark.read.schema(lifetimes.LOG).parquet(f"{path}/log")).drop("version").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})
