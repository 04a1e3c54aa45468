"""Further queries: policies, schedules, checks and name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import addresses, names, values
from ledgerfold.operators import policies, substrings
from ledgerfold.plans.registry import D, T, query
from ledgerfold.streaming import delta


@query("select id, case when upper(trim(st)) <> '' and upper(trim(st)) not in ('OH', 'TN') then 'state' when coalesce(trim(property_address), '') = '' then 'address' end as reason from (select *, case when orderkey % 29 = 0 then '' when orderkey % 31 <> 0 then lower(property_state) end st from listings)")
def prefilter_reason(t):
    state = F.when(F.col("orderkey") % 29 == 0, "").when(F.col("orderkey") % 31 != 0, F.lower("property_state"))
    return policies.prefilter(t.listings.withColumn("property_state", state), ["OH", "TN"]).select("id", "reason")


@query("select o_orderkey as k, case when o_custkey % 50 < 40 then date '1999-01-01' + (o_custkey % 50)::int end as scheduled from orders", prelude=False)
def sale_schedule_lookup(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "TS").otherwise(""), (F.col("o_custkey") % 50).cast("string")).alias("code_text"))
    schedule = t.spark.range(40).select(F.col("id").cast("string").alias("code"), F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("sale_date"))
    return policies.schedule_lookup(rows, schedule, "code_text", "TS").select("k", "scheduled")


@query("select a.id, a.case_number, a.market, min(b.parcel_number) as given from listings a join listings b on a.case_number = b.case_number and a.market = b.market where a.source_site = 'site_0' and a.parcel_number is null and b.source_site = 'site_1' and b.parcel_number is not null group by all")
def enrich_by_case(t):
    return policies.enrich_by_case(t.listings, "site_0", "site_1")


@query("select l.id, p.parcel_number as candidate from listings l join parcels p on split_part(l.property_address, ' ', 1) = split_part(p.situs_address, ' ', 1) and contains(upper(p.situs_address), upper(split_part(l.property_address, ' ', 2))) where l.parcel_number is null and l.property_address is not null")
def address_block_join(t):
    wanted = t.listings.filter("parcel_number is null and property_address is not null").select("id", F.col("property_address").alias("address"))
    return substrings.addresses_on_block(wanted, t.parcels).select("id", F.col("parcel_number").alias("candidate"))


# One third of the listings ask for one street, in longer and shorter spellings.
@query(r"""
, q as (select id, case when orderkey % 3 = 0 then 'Nation_1 road' when orderkey % 3 = 1 then property_city || ' St.' else lower(property_city) end as street, split_part(property_address, ' ', 1) as house from listings where parcel_number is null and property_address is not null),
 b as (select id, house, left(regexp_replace(street, '(?i) (road|st\.)$', ''), 20) as body from q)
select b.id, p.parcel_number as candidate from b join parcels p on p.situs_address ilike '%' || b.house || '%' and p.situs_address ilike '%' || b.body || '%' where regexp_full_match(p.parcel_number, '[0-9]{7}')""")
def address_substring_join(t):
    street = F.when(F.col("orderkey") % 3 == 0, "Nation_1 road").when(F.col("orderkey") % 3 == 1, F.concat("property_city", F.lit(" St."))).otherwise(F.lower("property_city"))
    address = F.concat_ws(" ", F.split_part("property_address", F.lit(" "), F.lit(1)), street)
    wanted = t.listings.filter("parcel_number is null and property_address is not null").select("id", address.alias("address"))
    spine = t.parcels.filter(F.col("parcel_number").rlike("^[0-9]{7}$")).select("parcel_number", "situs_address")
    return substrings.address_candidates(wanted, spine).select("id", F.col("parcel_number").alias("candidate"))


@query("select id, case when l.status = 'active' and l.market = 'summit' and l.signal_type = 'mortgage_foreclosure' and p.parcel_number is not null and owner_name is null and day is null and current_tax_balance < 5000 then 'expired' else l.status end as status from listings l left join parcels p on l.parcel_number = p.parcel_number and l.market = p.market left join (select parcel_number, max(sale_date) as day from sales group by 1 having max(sale_date) < date '1998-06-01') s on p.parcel_number = s.parcel_number")
def retire_empty(t):
    """Values and sales are unknown for some parcels: values where the balance is below 5000, sales where the last one is recent."""
    from ledgerfold.operators.folding import latest_sales

    latest = latest_sales(t.sales).withColumn("last_sale_date", F.when(F.col("last_sale_date") < "1998-06-01", F.col("last_sale_date")))
    valued = t.parcels.withColumn("current_market_value", F.when(~(F.col("current_tax_balance") < 5000), F.lit(1)))
    return policies.retire_empty(t.listings, valued, latest, "summit").select("id", "status")


@query("select id, case when status = 'active' and market = 'summit' and signal_type = 'mortgage_foreclosure' and (property_address like '1%0 %' or (parcel_number is null and lower(trim(property_city)) not in (select lower(min(n_name)) from nation group by n_regionkey))) then 'expired' else status end as status from listings")
def retire_outside(t):
    inside = [r[0] for r in t.nation.groupBy("n_regionkey").agg(F.lower(F.min("n_name"))).select(F.col("lower(min(n_name))")).collect()]  # five rows
    court = F.when(F.col("property_address").rlike("^1[0-9]*0 "), "41 n. perry st, Room 104").otherwise(F.col("property_address"))
    return policies.retire_outside(t.listings.withColumn("property_address", court), inside, "summit", "41 N PERRY ST").select("id", "status")


@query("select id, case when c.n % 2 = 0 then 'expired' else status end as status, case when c.n % 2 = 0 then 'Closed' when c.n is not null then 'Open again' else case_status end as case_status from listings l left join (select case_number, count(*) n from listings where case_number is not null group by 1 having count(*) > 2) c using (case_number)")
def probate_recheck(t):
    found = t.listings.filter("case_number is not null").groupBy("case_number").agg(F.count("*").alias("n")).filter("n > 2")
    checks = found.select("case_number", F.when(F.col("n") % 2 == 0, "Closed").otherwise("Open again").alias("case_status"))
    return policies.recheck(t.listings, checks.unionByName(checks).unionByName(checks.withColumn("case_status", F.lit("Zoned")))).select("id", "status", "case_status")


@query("select action, count(*) as n from (select case when n is null then case when o in ('confirmed', 'probable') then 'retire' else 'noop' end when o is not distinct from n then 'keep' when n in ('confirmed', 'probable') then 'retier' when o in ('confirmed', 'probable') then 'hide' else 'noop' end as action from (select match_confidence o, case orderkey % 4 when 0 then 'confirmed' when 1 then 'review' when 2 then 'unverified' end n from listings where signal_type = 'probate')) group by 1")
def resolution_actions(t):
    new = F.element_at(F.array(F.lit("confirmed"), F.lit("review"), F.lit("unverified"), F.lit(None)), (F.col("orderkey") % 4 + 1).cast("int"))
    return t.listings.filter("signal_type = 'probate'").select(policies.resolution_action(F.col("match_confidence"), new).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query("select id, 'https://maps.example.com/?q=' || replace(replace(property_address || ', ' || property_city || ', ' || property_state, ' ', '%20'), ',', '%2C') as link from listings")
def verify_links(t):
    return policies.verify_links(t.listings)


@query("select market, case_number, count(distinct parcel_number) as parcels from listings where signal_type = 'probate' and case_number is not null group by all having count(distinct parcel_number) > 1")
def quality_overmatch(t):
    return policies.overmatched(t.listings, cap=1)


@query(f"select id, market, last_seen_at from signals where signal_type = 'code_violation' and last_seen_at < {T} - interval 14 day order by last_seen_at, id limit 2000")
def quality_stale_open(t):
    return policies.stale_open(t.signals, t.now, days=14)


@query("select source_site, usual, latest, zeros from (select source_site, max(found) filter (r = 1) latest, count(*) filter (hits = 0) zeros, list_sort(list(found) filter (r > 1)) v, v[len(v) // 2 + 1] usual from (select *, row_number() over w r, sum((found > 0)::int) over (w rows unbounded preceding) hits from runs window w as (partition by source_site order by started_at desc)) group by 1) where usual > 0 and latest <= 0.9 * usual")
def long_zero_runs(t):
    return policies.long_zero_runs(t.runs, cursor=False, share=0.1)


@query("select p.market, parcels, owned, coalesce(signals, 0) as signals, coalesce(orphans, 0) as orphans from (select market, count(*) parcels, count(owner_name) owned from parcels group by 1) p left join (select s.market, count(*) signals, count(*) filter (k.parcel_number is null) orphans from (select * replace (case when id % 7 = 0 then 'shelby' else market end as market) from signals) s left join parcels k on s.parcel_number = k.parcel_number and s.market = k.market group by 1) s on s.market = p.market")
def identity_proof(t):
    return policies.identity_proof(t.parcels, t.signals.withColumn("market", F.when(F.col("id") % 7 == 0, "shelby").otherwise(F.col("market"))))


@query("select id, coalesce(case when orderkey % 3 <> 0 then l.market end, p.market, case property_state when 'TN' then 'shelby' when 'MI' then 'wayne' end) as market from listings l left join (select parcel_number, market from parcels) p using (parcel_number)")
def infer_market(t):
    rows = t.listings.withColumn("market", F.when(F.col("orderkey") % 3 != 0, F.col("market")))
    return policies.infer_market(rows, t.parcels, {"TN": "shelby", "MI": "wayne"}).select("id", "market")


@query("select source_site, count(*) as found, count(*) filter (property_address is not null) as passed, count(*) filter (property_address is null) as filtered, count(*) filter (orderkey % 2 = 0 and property_address is not null) as inserted, 0::bigint as errors, 'success' as status from listings where source_site = 'site_1' group by 1")
def run_record(t):
    """A run is of one source, so the query reads one."""
    rows = t.listings.filter("source_site = 'site_1'").withColumn("is_new", F.col("orderkey") % 2 == 0)
    return policies.run_record("site_1", policies.prefilter(rows, ["OH", "TN", "MI"]))


@query(f"select parcel_number, market from (select distinct parcel_number, market from signals where observed_at < {T} - interval 2 day) except select parcel_number, market from signals where observed_at >= {T} - interval 2 day")
def absence_retire(t):
    """Signals of before and after a day: every row is on one side."""
    cut = t.now - F.make_dt_interval(F.lit(2))
    keys = ["parcel_number", "market"]
    return policies.retire_absent(t.signals.filter(F.col("observed_at") < cut).select(*keys).distinct(), t.signals.filter(F.col("observed_at") >= cut), keys)


@query(f"select id, observed_at from signals where observed_at >= {T} - interval 5 day - interval 1 day")
def delta_with_overlap(t):
    import datetime

    from ledgerfold.plans.tables import NOW

    return delta.delta(t.signals, "observed_at", NOW - datetime.timedelta(days=5)).select("id", "observed_at")


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, sum(value) as total from events group by all", prelude=False)
def daily_windows(t):
    """An extension: tumbling event-time windows."""
    out = t.events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n", "total")


@query("select p_partkey as k, case when p_name = split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) then 1.0 else 1.0 end as swapped, 0.0 as single from part", prelude=False)
def name_confidence(t):
    n = F.col("p_name")
    turned = F.concat(F.split_part(n, F.lit(" "), F.lit(2)), F.lit(", "), F.split_part(n, F.lit(" "), F.lit(1)))
    return t.part.select(F.col("p_partkey").alias("k"), names.name_confidence(n, turned).alias("swapped"), names.name_confidence(F.split_part(n, F.lit(" "), F.lit(1)), turned).alias("single"))


@query("select p_partkey as k, upper(split_part(p_name, ' ', 2)) as decedent, upper(split_part(p_name, ' ', 1)) as owner, split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2) as mismatch from part", prelude=False)
def surname_mismatch(t):
    n = F.col("p_name")
    return t.part.select(F.col("p_partkey").alias("k"), names.decedent_surname(F.concat(n, F.lit(" Jr"))).alias("decedent"), names.owner_surname(n).alias("owner"), names.surname_mismatch(n, n).alias("mismatch"))


@query("""select id, case when property_address is null then 'empty_address' when k = 0 then 'case_number_prefix' when k = 1 then 'legal_notice_text' when k = 2 then 'multi_property_notice' when k = 3 then 'office_suite'
  when k = 4 then 'malformed_address' when k in (5, 6) then 'no_street_number' when k = 7 then 'address_too_long' when k = 8 then 'empty_address' when k = 9 then 'case_number_prefix' end as problem, property_address is null or k in (0, 3, 4, 7) or k >= 10 as numbered
  from (select *, orderkey % 13 k from listings)""")
def address_sanity(t):
    """Landed addresses of every kind, by the order's number."""
    a, k = F.col("property_address"), F.col("orderkey") % 13
    landed = ["24-CV-118 ", "Notice of Sale: ", "ARTA ", None, None, "Rear of ", "No. ", None, None, "Case No. 7, Notice of Sale, "]
    kinds = {0: F.concat(F.lit(landed[0]), a), 1: F.concat(F.lit(landed[1]), a), 2: F.concat(F.lit(landed[2]), a), 3: F.concat(a, F.lit(" Suite 20")), 4: F.concat(F.lit("12, "), a), 5: F.concat(F.lit(landed[5]), a), 6: F.concat(F.lit(landed[6]), a),
             7: F.concat(a, F.repeat(F.lit(" far"), 60)), 8: F.when(a.isNotNull(), " "), 9: F.concat(F.lit(landed[9]), a)}
    text = F.coalesce(*[F.when(k == n, v) for n, v in kinds.items()], F.when(k >= 10, a))
    return t.listings.select("id", addresses.address_problem(text).alias("problem"), F.coalesce(addresses.has_street_number(text), F.lit(True)).alias("numbered"))


@query("select id, case when case_status like 'CLOSED%' then 'Closed' when case_status = 'Open' then 'Open' else 'Unknown' end as bucket, regexp_replace(case_number, '[^0-9]', '', 'g') as digits, case when opening_bid_usd > 100000 then true end as delinquent from listings")
def status_buckets(t):
    return t.listings.select("id", values.violation_bucket(F.col("case_status")).alias("bucket"), values.case_digits(F.col("case_number")).alias("digits"), values.is_delinquent(F.lit(None).cast("boolean"), F.col("opening_bid_usd") - 100000).alias("delinquent"))


@query("select event_id as id, (ts at time zone 'UTC' at time zone 'America/New_York')::date as day from events", prelude=False)
def eastern_days(t):
    return t.events.select(F.col("event_id").alias("id"), values.eastern_day(F.col("ts")).alias("day"))


@query(f"select market, count(*) as n, count(*) filter (last_seen_at >= {T} - interval 4 day) as live, count(*) filter (last_seen_at < {T} - interval 4 day) as lapsed from signals group by 1")
def signal_ttl(t):
    live = F.col("last_seen_at") >= t.now - F.make_dt_interval(F.lit(4))
    return t.signals.groupBy("market").agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.count_if(~live).alias("lapsed"))
