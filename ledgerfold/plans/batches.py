"""Queries of upserts whose rows see each other, counted merges, samples and migrations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerfold.operators import merging, migrations, sampling, sequencing
from ledgerfold.plans import tables
from ledgerfold.plans.registry import query

_GROUPS = ", g as (select source_site, case_number, parcel_number, min(id) as id, min(orderkey) as k from listings where case_number is not null and parcel_number is not null group by all)"


@query(_GROUPS + """
select l.id, case when g.k is null then l.property_address else 'MOVED ' || g.k end as property_address, case when g.k is null then l.status else 'expired' end as status, (case when g.k is null then l.opening_bid_usd when g.k % 2 = 0 then g.k + 1 else g.k end)::double as bid,
  (case when g.k is null then l.last_seen else greatest(l.last_seen, date '1998-07-02') end)::date as last_seen, false as is_new from listings l left join g on l.id = g.id
union all
select 'new|' || source_site || '|' || (2 * k + 1000000000000), 'NEW ' || k, 'expired', (case when k % 2 = 0 then k + 1 else k end)::double, date '1998-07-02', true from g where k % 3 = 0""")
def upsert_in_order(t):
    """For each listing that its case and parcel find, one row moves it and the next finds it by its new address; one third bring a new parcel, which the row after finds by its address."""
    columns = ["source_site", "market", "case_number", "parcel_number", "property_address", "sale_date", "status", "opening_bid_usd", "last_seen"]
    first = t.listings.filter("case_number is not null and parcel_number is not null").groupBy("source_site", "case_number", "parcel_number").agg(F.min_by(F.struct("market", "sale_date", "orderkey"), "id").alias("x"))
    g = first.select("source_site", "case_number", "parcel_number", "x.*").withColumn("none", F.lit(None).cast("string"))
    k, cents = F.col("orderkey"), "decimal(18,2)"

    def row(seq, case, parcel, address, day, status, bid, seen):
        return F.struct(
            seq.alias("seq"), "source_site", "market", case.alias("case_number"), parcel.alias("parcel_number"), F.concat(F.lit(address), k.cast("string")).alias("property_address"), day.cast("date").alias("sale_date"), F.lit(status).alias("status"),
            bid.cast(cents).alias("opening_bid_usd"), F.lit(seen).cast("date").alias("last_seen"),
        )

    late, more = F.lit(1_000_000_000_000), F.when(k % 2 == 0, k + 1)
    none = F.col("none")
    moves = [row(2 * k, F.col("case_number"), F.col("parcel_number"), "MOVED ", none, "active", k, "1998-07-01"), row(2 * k + 1, none, none, "MOVED ", F.col("sale_date"), "expired", more, "1998-07-02")]
    new = [row(2 * k + late, none, F.concat(F.lit("R"), k.cast("string")), "NEW ", none, "active", k, "1998-07-01"), row(2 * k + late + 1, none, none, "NEW ", none, "expired", more, "1998-07-02")]
    batch = g.select(F.explode(F.when(k % 3 == 0, F.array(*moves, *new)).otherwise(F.array(*moves))).alias("r")).select("r.*")
    out = sequencing.upsert_in_order(t.listings.select("id", *columns), batch, "seq")
    return out.select("id", "property_address", "status", F.col("opening_bid_usd").cast("double").alias("bid"), "last_seen", "is_new")


_SIGNAL = "parcel_number, market, signal_type, source"


@query(f"""
, c as (select {_SIGNAL}, arg_max(balance, id) filter (balance is not null) as balance, arg_max(last_seen_at, id) as seen from signals where id % 2 = 0 group by all),
 b as (select {_SIGNAL}, arg_max(x, id) filter (x is not null) as balance, arg_max(last_seen_at, id) as seen from (select *, case when id % 7 < 3 then balance + 1 when id % 7 < 6 then balance end as x from signals where id % 3 = 0) group by all),
 m as (select coalesce(c.market, b.market) as market, c.seen is null as is_new, b.seen is not null as came, coalesce(b.balance, c.balance) is distinct from c.balance or coalesce(b.seen, c.seen) is distinct from c.seen as differs
  from c full join b on c.parcel_number = b.parcel_number and c.market = b.market and c.signal_type is not distinct from b.signal_type and c.source = b.source)
select market, count(*) as rows, count(*) filter (is_new) as inserted, count(*) filter (not is_new and differs) as updated, count(*) filter (not is_new and came and not differs) as confirmed, count(*) filter (not came) as untouched from m group by market""")
def upsert_signals_counted(t):
    """Signals merged by parcel, market, type and source; a dry run must count what the run itself counts, and both what the merged table says."""
    keys = _SIGNAL.split(", ")
    kept = t.signals.select(*keys, "id", "balance", F.col("last_seen_at").alias("seen"))
    current = merging.collapse(kept.filter("id % 2 = 0"), keys, "id")
    came = kept.filter("id % 3 = 0").withColumn("balance", F.when(F.col("id") % 7 < 3, (F.col("balance") + 1).cast("decimal(18,2)")).when(F.col("id") % 7 < 6, F.col("balance")))
    merged = merging.upsert(current, merging.collapse(came, keys, "id"), keys, mark_changes=True)
    counts = merging.write_counted(merged, None)
    old = ~F.col("is_new")
    out = merged.groupBy("market").agg(
        F.count("*").alias("rows"), F.count_if("is_new").alias("inserted"), F.count_if(old & F.col("is_changed")).alias("updated"), F.count_if(old & F.col("came") & ~F.col("is_changed")).alias("confirmed"), F.count_if(old & ~F.col("came")).alias("untouched"),
    )
    total = out.agg(*[F.sum(c).alias(c) for c in counts]).first().asDict()
    if total != counts:
        raise AssertionError(f"the dry run counted {counts}, the table has {total}")
    return out


@query("""
, taken as (select id, signal_type, md5('7:' || id) as h from listings where signal_type in ('probate', 'tax_deed') qualify row_number() over (partition by signal_type order by substr(md5('7:' || id), 1, 15), id) <= 400),
 rest as (select id, signal_type from listings where id not in (select id from taken) order by substr(md5('8:' || id), 1, 15), id limit (select greatest(0, 1500 - count(*)) from taken))
select id, signal_type, false as filled from taken union all select id, signal_type, true from rest""")
def sample_with_fill(t):
    return sampling.quotas_and_fill(t.listings.select("id", "signal_type"), "signal_type", ["probate", "tax_deed"], 400, 1500, "id")


_OLD = """
, p as (select case when custkey % 5 = 0 then 'AB' || lpad(custkey::varchar, 12, '0') else parcel_number end as parcel_number, case when custkey % 7 = 0 then 'N' || custkey end as native, case when custkey % 9 = 0 then market end as market, case when custkey % 9 = 0 then property_state end as state, custkey from parcels),
 l as (select l.id, p.parcel_number, case when orderkey % 11 <> 0 then case when l.property_state = 'MI' then 'OH' else l.property_state end end as state, case when orderkey % 10 = 0 then l.market end as market from listings l left join p on l.parcel_number = lpad(p.custkey::varchar, 7, '0')),
 told as (select parcel_number, count(*) filter (state = 'TN') as tn, count(*) filter (state = 'OH') as oh from l group by 1),
 p1 as (select p.*, case when market is not null then market when native is not null or regexp_full_match(parcel_number, '[0-9A-Za-z]{14}') then 'shelby' else 'cuyahoga' end as m1 from p),
 p2 as (select p1.parcel_number, case when m1 = 'cuyahoga' and tn > 0 and oh = 0 then 'shelby' else m1 end as market,
   case when m1 = 'cuyahoga' and tn > 0 and oh = 0 then 'TN' when p1.market is not null then state when m1 = 'shelby' then 'TN' else 'OH' end as state from p1 left join told on told.parcel_number = p1.parcel_number)"""


@query(_OLD + """
select 'parcel' as kind, parcel_number as id, market, state as property_state from p2
union all select 'listing', l.id, coalesce(l.market, p2.market, case l.state when 'OH' then 'cuyahoga' when 'TN' then 'shelby' end), l.state from l left join p2 on l.parcel_number = p2.parcel_number and l.state = p2.state""")
def market_migrations(t):
    """Tables from before markets, landed as the first migration; columns are added, then markets filled in, each a migration with its guards."""
    k, old = F.col("custkey"), t.parcels
    p = old.select(
        F.when(k % 5 == 0, F.concat(F.lit("AB"), F.lpad(k.cast("string"), 12, "0"))).otherwise(F.col("parcel_number")).alias("parcel_number"), F.when(k % 7 == 0, F.concat(F.lit("N"), k.cast("string"))).alias("native_parcel_id"),
        F.when(k % 9 == 0, F.col("market")).alias("market"), F.when(k % 9 == 0, F.col("property_state")).alias("property_state"), F.col("parcel_number").alias("was"),
    )
    named = t.listings.join(p.select(F.col("was").alias("parcel_number"), F.col("parcel_number").alias("now")), "parcel_number", "left")
    state = F.when(F.col("orderkey") % 11 != 0, F.when(F.col("property_state") == "MI", "OH").otherwise(F.col("property_state")))
    listings = named.select("id", F.col("now").alias("parcel_number"), state.alias("property_state"), F.when(F.col("orderkey") % 10 == 0, F.col("market")).alias("market"))
    unplaced = lambda x: x["parcels"].filter("market is null or property_state is null")
    steps = [
        migrations.Migration("001", lambda x: {"parcels": p.drop("was", "property_state"), "listings": listings}),
        migrations.Migration("002", lambda x: {"parcels": migrations.with_column("property_state", "string")(x["parcels"]).drop("property_state").join(p.select("parcel_number", "property_state"), "parcel_number")}),
        migrations.Migration("003", lambda x: {"parcels": migrations.parcel_markets(x["parcels"], x["listings"])}, after={"a parcel has no market": unplaced}),
        migrations.Migration("004", lambda x: {"listings": migrations.row_markets(x["listings"], x["parcels"])}, before={"a parcel has no market": unplaced}),
    ]
    now = migrations.migrate(t.spark, f"{tables.shared_folder(t.spark)}/database-{uuid.uuid4().hex}", steps)
    rows = lambda name, kind, key: now[name].select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "market", "property_state")
    return rows("parcels", "parcel", "parcel_number").unionByName(rows("listings", "listing", "id"))
