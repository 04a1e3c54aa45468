"""All queries of the library by name, and their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import addresses, names, parcels, values
from ledgerfold.operators import audits, folding, leads, lifecycle, merging, reading, resolving, sampling
from ledgerfold.plans import tables
from ledgerfold.plans.tables import AS_OF, NOW, PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

D, T = f"date '{AS_OF}'", f"timestamp '{NOW}'"


def query(sql: str | None = None, *, prelude: bool = True):
    """Registers a function of the tables under its name, with its SQL (over the derived tables unless ``prelude`` is off)."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (PRELUDE + "\n" + sql) if prelude else sql
        return f

    return register


class Tables:
    """The derived tables of a folder, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        build = getattr(tables, name, None)
        return build(self.spark, self.sf_dir) if build else tables.raw(self.spark, self.sf_dir, name)

    @property
    def as_of(self) -> Column:
        return F.lit(AS_OF)

    @property
    def now(self) -> Column:
        return F.lit(NOW)

    @property
    def enriched(self) -> DataFrame:
        return reading.enrich(self.listings, self.parcels, self.signals)

    @property
    def latest(self) -> DataFrame:
        return folding.latest_sales(self.sales)


# Label of each type that occurs in the derived tables.
_LABEL = "case {0} when 'mortgage_foreclosure' then 'Foreclosure (Mortgage)' when 'probate' then 'Probate' when 'code_violation' then 'Code Violation' when 'blight_violation' then 'Code Violation' when 'tax_delinquent' then 'Tax Distress' when 'tax_deed' then 'Tax Distress' when 'eviction' then 'Eviction' end"
_STACK = """
, by_type as (select parcel_number, market, signal_type, count(*) n from signals group by all),
stacked as (select parcel_number, market, sum(n)::bigint signal_count, list({'t': signal_type, 'n': n} order by length(signal_type), signal_type) types from by_type group by all)"""
_ENTITY = "regexp_matches(owner_name, '\\b(" + names.ENTITY_WORDS + ")\\b', 'i')"
_ENRICH = _STACK + f"""
, e as (
  select l.*, coalesce(p.owner_name, '(Owner not found)') owner, {_ENTITY.replace("owner_name", "p.owner_name")} entity, p.parcel_number is not null registry_confirmed, p.current_tax_balance, p.property_class, coalesce(s.signal_count, 0) signal_count, s.types
  from listings l left join parcels p on l.parcel_number = p.parcel_number and l.market = p.market left join stacked s on l.parcel_number = s.parcel_number and l.market = s.market),
lab as (select id, label, min(ord) ord, arg_min(n, ord) n from (
    select id, {_LABEL.format("signal_type")} label, 0 ord, 1::bigint n from listings
    union all select id, {_LABEL.format("types[k].t")}, k, types[k].n from (select id, types, unnest(generate_series(1, len(types))) k from e where types is not null)
  ) where label is not null group by id, label),
chip as (select id, string_agg(label || '=' || n, ',' order by ord) chips, count(*)::int dimensions from lab group by id),
r as (select e.*, coalesce(chips, '') chips, coalesce(dimensions, 0) dimensions, coalesce(dimensions, 0) >= 2 hot from e left join chip using (id))"""
_GATES = """not (coalesce(signal_type, '') = 'probate' and coalesce(case_status ilike '%closed%' or case_status ilike '%dismissed%' or case_status ilike '%terminated%', false))
  and (signal_type is distinct from 'probate' or coalesce(match_confidence in ('confirmed', 'probable', 'review'), false))"""
_ROW = "id, market, parcel_number, signal_type, status, sale_date, first_seen, opening_bid_usd::double as opening_bid, owner, entity, registry_confirmed, signal_count, chips, dimensions, hot"


def _row(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("chips", lambda x: F.concat(x["label"], F.lit("="), x["count"].cast("string"))), ",")
    return df.select(
        "id", "market", "parcel_number", "signal_type", "status", "sale_date", "first_seen", F.col("opening_bid_usd").cast("double").alias("opening_bid"), F.col("owner_name").alias("owner"),
        F.col("owner_is_entity").alias("entity"), "registry_confirmed", "signal_count", text.alias("chips"), "dimensions", "hot",
    )


# ---- the read path


@query(_ENRICH + f"select {_ROW} from r where distress_stage = 'buy_now' and {_GATES} order by first_seen desc nulls last, id limit 50")
def listings_page(t):
    return _row(reading.listings_page(t.listings, t.parcels, t.signals, reading.ListingQuery()))


@query(_ENRICH + f"select {_ROW} from r where status = 'active' and market = 'summit' and {_GATES} order by opening_bid_usd asc nulls last, id limit 20 offset 20")
def listings_second_page(t):
    return _row(reading.listings_page(t.listings, t.parcels, t.signals, reading.ListingQuery(distress_stage="all", status="active", market="summit", sort="opening_bid", descending=False, page=2, page_size=20)))


@query(_ENRICH + f"select count(*) as total, greatest(1, ceil(count(*) / 50.0))::bigint as pages from r where distress_stage = 'buy_now' and signal_count > 0 and signal_count >= 2 and current_tax_balance >= 1000 and {_GATES} and property_city ilike 'nation_1%' and property_address ilike '%street%' and list_contains(list_transform(types, lambda x: x.t), 'eviction')")
def listings_count_filtered(t):
    return reading.listing_counts(t.listings, t.parcels, t.signals, reading.ListingQuery(has_signals=True, min_signals=2, min_balance=1000, city="nation_1%", text="street", signal_type="eviction"))


@query(_ENRICH + f"select market, count(*) as n from r where distress_stage = 'buy_now' and coalesce(entity, false) and {_GATES} group by market")
def owner_entity_filter(t):
    return reading.select_listings(t.enriched, reading.ListingQuery(owner_type="entity")).groupBy("market").agg(F.count("*").alias("n"))


@query(_ENRICH + f"select market, count(*) as n from r where distress_stage = 'buy_now' and signal_count = 0 and not coalesce(entity, false) and {_GATES} group by market")
def has_signals_false(t):
    return reading.select_listings(t.enriched, reading.ListingQuery(has_signals=False, owner_type="individual")).groupBy("market").agg(F.count("*").alias("n"))


@query(_STACK + "select parcel_number, market, signal_count, list_aggregate(list_transform(types, lambda x: x.t || '=' || x.n), 'string_agg', ',') as types from stacked")
def signal_stack(t):
    s = reading.stack_signals(t.signals)
    return s.select("parcel_number", "market", "signal_count", F.array_join(F.transform("type_counts", lambda x: F.concat(x["type"], F.lit("="), x["n"].cast("string"))), ",").alias("types"))


@query(_ENRICH + "select id, chips, dimensions, hot from r")
def signal_chips_hot(t):
    return _row(t.enriched).select("id", "chips", "dimensions", "hot")


@query("select l.id, l.market from listings l where exists (select 1 from signals s where s.parcel_number = l.parcel_number and s.market = l.market and s.signal_type = 'eviction')")
def exists_signal(t):
    return t.listings.join(t.signals.filter("signal_type = 'eviction'").select("parcel_number", "market"), ["parcel_number", "market"], "left_semi").select("id", "market")


@query("select s.id, s.signal_type, s.observed_at, s.balance::double as balance from signals s join (select distinct parcel_number, market from listings where parcel_number = '0000005') l using (parcel_number, market)")
def listing_detail(t):
    one = t.listings.filter("parcel_number = '0000005'").select("parcel_number", "market").distinct()
    return t.signals.join(one, ["parcel_number", "market"]).orderBy(F.desc("observed_at"), "id").select("id", "signal_type", "observed_at", F.col("balance").cast("double"))


@query(f"select source_site, day, started_at, found, active, status, floor(date_diff('second', date_trunc('second', started_at), {T}) / 60)::bigint as minutes_since, status = 'success' and date_diff('second', date_trunc('second', started_at), {T}) <= 48 * 3600 as online from runs qualify row_number() over (partition by source_site order by started_at desc) = 1")
def sources_latest(t):
    return reading.source_cards(t.runs, t.now, hours=48)


# ---- upserts


#: Signals of before and after a day: every row is on one side.
_CUT, _FIRST = NOW - datetime.timedelta(days=15), NOW - datetime.timedelta(days=29)
_HALVES = f", old as (select parcel_number, market, max(balance) balance, max(source) source, max(observed_at) seen from signals where observed_at < timestamp '{_CUT}' group by all), new as (select parcel_number, market, case when count(*) % 3 <> 0 then max(balance) end balance, max(source) source, case when count(*) % 2 = 0 then max(observed_at) end seen from signals where observed_at >= timestamp '{_CUT}' group by all)"


@query(_HALVES + "select coalesce(o.parcel_number, n.parcel_number) as parcel_number, coalesce(o.market, n.market) as market, coalesce(n.balance, o.balance)::double as balance, coalesce(o.source, n.source) as source, case when n.parcel_number is not null then n.seen else o.seen end as seen, o.parcel_number is null as is_new from old o full join new n on o.parcel_number = n.parcel_number and o.market = n.market")
def upsert_merge(t):
    keys = ["parcel_number", "market"]
    agg = [F.max("source").alias("source")]
    old = t.signals.filter(F.col("observed_at") < F.lit(_CUT)).groupBy(*keys).agg(F.max("balance").alias("balance"), *agg, F.max("observed_at").alias("seen"))
    new = t.signals.filter(F.col("observed_at") >= F.lit(_CUT)).groupBy(*keys).agg(F.when(F.count("*") % 3 != 0, F.max("balance")).alias("balance"), *agg, F.when(F.count("*") % 2 == 0, F.max("observed_at")).alias("seen"))
    return merging.upsert(old, new, keys, overwrite=("seen",), keep=("source",)).withColumn("balance", F.col("balance").cast("double"))


@query("select parcel_number, signal_type, source, observed_at::date as day, arg_max(payload, id) as payload, arg_max(balance, id) filter (id % 3 <> 0) ::double as balance from signals group by all")
def upsert_signals_batch(t):
    rows = t.signals.withColumn("day", F.to_date("observed_at")).withColumn("balance", F.when(F.col("id") % 3 != 0, F.col("balance").cast("double")))
    return merging.collapse(rows.select("parcel_number", "signal_type", "source", "day", "payload", "balance", "id"), ["parcel_number", "signal_type", "source", "day"], "id")


@query(f"select distinct parcel_number, signal_type from signals s where observed_at >= timestamp '{_FIRST}' and not exists (select 1 from signals o where o.observed_at < timestamp '{_FIRST}' and o.parcel_number = s.parcel_number and o.signal_type = s.signal_type)")
def insert_absent(t):
    keys = ["parcel_number", "signal_type"]
    return merging.insert_absent(t.signals.filter(F.col("observed_at") < F.lit(_FIRST)), t.signals.filter(F.col("observed_at") >= F.lit(_FIRST)).select(*keys), keys)


@query("select parcel_number, market, arg_min(property_address, id) filter (property_address is not null) as situs_address, 'stub:listing' as source_url from listings l where parcel_number is not null and not exists (select 1 from parcels p where p.owner_name is not null and p.parcel_number = l.parcel_number and p.market = l.market) group by all")
def stub_parcels(t):
    """The spine here has the parcels with a known owner; listings of the others need a stub."""
    rows = t.listings.filter("property_address is not null or parcel_number is not null")
    named = rows.groupBy("parcel_number", "market").agg(F.min_by("property_address", F.when(F.col("property_address").isNotNull(), F.col("id"))).alias("property_address"), F.min("id").alias("id"))
    return merging.stub_parcels(named, t.parcels.filter("owner_name is not null"))


@query("select parcel_number, coalesce(last_price, price)::double as price from (select parcel_number, max(case when custkey % 5 = 0 then null else current_tax_balance end) price from parcels group by 1) a join (select parcel_number, max(price) last_price from sales group by 1) b using (parcel_number) where price is distinct from coalesce(last_price, price)")
def overlay_changed(t):
    old = t.parcels.groupBy("parcel_number").agg(F.max(F.when(F.col("custkey") % 5 != 0, F.col("current_tax_balance"))).alias("price"))
    new = t.sales.groupBy("parcel_number").agg(F.max("price").alias("price"))
    return merging.overlay_changed(old, new, "parcel_number", ["price"]).withColumn("price", F.col("price").cast("double"))


_STALE = f"""case when status not in ('not_listed', 'cancelled', 'sold', 'expired') and last_seen < date '1998-01-01' and not ((signal_type = 'tax_deed' and (redemption_status = 'pending' or sale_date < {D})) or (market = 'wayne' and signal_type = 'mortgage_foreclosure' and date_diff('day', sale_date, {D}) <= 180)) then 'not_listed' else status end"""


@query(f"select id, o.status as old, n.status as new, 'changed' as change from listings o join (select id, {_STALE} as status from listings) n using (id) where o.status is distinct from n.status")
def mark_stale(t):
    after = lifecycle.mark_stale(t.listings, F.lit("1998-01-01").cast("date"), t.as_of)
    return merging.snapshot_diff(t.listings, after, "id", "status")


_EXPIRED = f"case when sale_date < {D} and status in ('active', 'not_listed') and not coalesce((signal_type = 'tax_deed' and (redemption_status is null or redemption_status = 'pending')) or (market = 'wayne' and signal_type = 'mortgage_foreclosure' and date_diff('day', sale_date, {D}) <= 180), false) then 'expired' else status end"


@query(f"select id, {_EXPIRED} as status from listings")
def mark_expired(t):
    return lifecycle.mark_expired(t.listings, t.as_of).select("id", "status")


@query(r"select id, case when not regexp_matches(property_address, '^\s*[0-9]') then 'no_street_number' end as address_status from listings")
def flag_address(t):
    return lifecycle.flag_addresses(t.listings).select("id", "address_status")


@query("""select id, case when status = 'active' and (d > first_seen or (signal_type = 'probate' and regexp_matches(c, '^[0-9]{4}( ES|EST)') and d >= make_date(try_cast(c[1:4] as bigint), 1, 1))
  or (signal_type = 'probate' and d >= filing_date) or (market = 'lucas' and signal_type = 'mortgage_foreclosure' and regexp_matches(c, '^[0-9]{4}') and d >= make_date(try_cast(c[1:4] as bigint), 1, 1))) then 'transferred' else status end as status
from (select *, case when market = 'shelby' then first_seen - 400 end filing_date, case when market = 'lucas' then (1990 + orderkey % 12) || 'CV' || orderkey when market = 'summit' then replace(case_number, 'EST', ' ES ') else case_number end c from listings)
left join (select parcel_number, max(sale_date) d from sales group by 1) using (parcel_number)""")
def mark_transferred(t):
    case = F.when(F.col("market") == "lucas", F.concat((1990 + F.col("orderkey") % 12).cast("string"), F.lit("CV"), F.col("orderkey").cast("string"))).when(F.col("market") == "summit", F.replace("case_number", F.lit("EST"), F.lit(" ES "))).otherwise(F.col("case_number"))
    rows = t.listings.withColumn("case_number", case).withColumn("filing_date", F.when(F.col("market") == "shelby", F.date_sub("first_seen", 400)))
    return lifecycle.mark_transferred(rows, t.latest, year_foreclosures={"lucas": "^[0-9]{4}"}).select("id", "status")


@query("""select id, case when y >= 8 then 90 when y >= 5 then 180 else 365 end as days, case when y >= 8 then '8yr_plus' when y >= 5 then '5_to_7yr' when y is not null then 'le_5yr' else 'default_assumed' end as basis,
(ordered + case when y >= 8 then 90 when y >= 5 then 180 else 365 end)::date as ends, 'pending' as state
from (select l.*, case when orderkey % 3 <> 0 then sale_date + (orderkey % 20)::int end ordered, p.tax_years_delinquent y from listings l left join parcels p on l.parcel_number = p.parcel_number and l.market = p.market
  where signal_type = 'tax_deed' and l.market = 'shelby' and (redemption_status is null or redemption_status = 'pending')) where ordered is not null""")
def redemption_windows(t):
    ordered = F.when(F.col("orderkey") % 3 != 0, F.date_add("sale_date", (F.col("orderkey") % 20).cast("int")))
    return lifecycle.redemption_windows(t.listings.withColumn("confirmation_order_date", ordered), t.parcels).select("id", F.col("redemption_status").alias("state"), F.col("redemption_window_days").alias("days"), F.col("redemption_basis").alias("basis"), F.col("redemption_ends").alias("ends"))


@query(f"select id, (sale_date + 180)::date as ends, case when sale_date < {D} and (sale_date + 180)::date >= {D} then 'pending' end as state from listings where market = 'wayne' and signal_type = 'mortgage_foreclosure' and sale_date is not null")
def mi_redemption(t):
    return lifecycle.michigan_redemption(t.listings, t.as_of).select("id", F.col("redemption_ends").alias("ends"), F.col("redemption_status").alias("state"))


@query(f"select id, case when redemption_status = 'pending' and (sale_date + 365)::date < {D} then 'final' else status end as status, case when redemption_status = 'pending' and (sale_date + 365)::date < {D} then 'final' else redemption_status end as state from listings where signal_type = 'tax_deed'")
def finalize_redemptions(t):
    deeds = t.listings.filter("signal_type = 'tax_deed'").withColumn("redemption_ends", F.date_add("sale_date", 365))
    return lifecycle.finalize_redemptions(deeds, t.as_of).select("id", "status", F.col("redemption_status").alias("state"))


_KEY = "coalesce(nullif(parcel_number, ''), regexp_replace(lower(property_address), '_|street$', '', 'g') || 'st')"


@query(f", k as (select *, {_KEY} as key from listings), best as (select market, key, first(id order by sale_date is null, sale_date desc nulls last, first_seen, id) as best from k where status in ('active', 'not_listed') and key is not null group by all) select id, case when status in ('active', 'not_listed') and best <> id then best end as duplicate_of from k left join best on k.market = best.market and k.key = best.key")
def dedup_canonical(t):
    return lifecycle.mark_duplicates(t.listings).select("id", "duplicate_of")


@query(", k as (select *, lower(property_address) a, regexp_replace(case_number, '[^0-9]', '', 'g') d from listings where property_address is not null and regexp_replace(case_number, '[^0-9]', '', 'g') <> ''), c as (select market, a, d, min(id) canonical from k where parcel_number is not null group by all having count(*) = 1) select k.id, c.canonical from k join c using (market, a, d) where k.parcel_number is null")
def dedup_twin(t):
    return lifecycle.attach_twins(t.listings)


@query("select p.parcel_number, p.market, arg_max('OWNER ' || s.id, {'t': s.observed_at, 'i': s.id}) as owner_name from parcels p join signals s on p.parcel_number = s.parcel_number where p.owner_name is null and p.market = 'shelby' and s.signal_type = 'tax_delinquent' group by all")
def owner_backfill(t):
    named = t.signals.withColumn("payload", F.to_json(F.struct(F.concat(F.lit(" OWNER "), F.col("id").cast("string")).alias("owner"), "balance")))
    return lifecycle.owner_backfill(t.parcels, named)


# ---- leads


_RULE = leads.LeadRule("tax_delinquent", fresh_days=21, min_balance=1000)
_LEADS = f", fresh as (select * from signals where signal_type = 'tax_delinquent' and last_seen_at >= {T} - interval 21 day and balance >= 1000), leads as (select * from listings where distress_stage = 'distress_signal'), sale as (select * from listings where distress_stage = 'buy_now'), latest as (select parcel_number, max(sale_date) last_sale_date from sales group by 1)"


@query(_LEADS + "select id, parcel_number, market from leads l where status = 'active' and signal_type = 'tax_delinquent' and (not exists (select 1 from fresh f where f.parcel_number = l.parcel_number and f.market = l.market) or exists (select 1 from sale b where b.status = 'active' and b.parcel_number = l.parcel_number and b.market = l.market))")
def surface_retire(t):
    lead, sale = t.listings.filter("distress_stage = 'distress_signal'"), t.listings.filter("distress_stage = 'buy_now'")
    return leads.retiring(lead, t.signals, sale, _RULE, t.now).select("id", "parcel_number", "market")


@query(_LEADS + f"select f.parcel_number, f.market, 'tax_delinquent' as signal_type, situs_address, owner_name, f.id as signal_id, f.balance::double as balance, f.observed_at::date as observed from (select * from fresh qualify row_number() over (partition by parcel_number, market order by observed_at desc, id desc) = 1) f left join parcels p on p.parcel_number = f.parcel_number and p.market = f.market left join latest s on s.parcel_number = f.parcel_number where not exists (select 1 from leads l where l.signal_type = 'tax_delinquent' and l.parcel_number = f.parcel_number and l.market = f.market) and not exists (select 1 from sale b where b.status = 'active' and b.parcel_number = f.parcel_number and b.market = f.market) and (last_sale_date is null or last_sale_date < ({T} - interval 12 month)::date)")
def surface_insert(t):
    lead, sale = t.listings.filter("distress_stage = 'distress_signal'"), t.listings.filter("distress_stage = 'buy_now'")
    return leads.inserting(lead, t.signals, sale, t.parcels, t.latest, _RULE, t.now).withColumn("balance", F.col("balance").cast("double"))


@query(_LEADS + "select l.id, max(f.last_seen_at)::date as seen from leads l join fresh f on f.parcel_number = l.parcel_number and f.market = l.market where l.status = 'active' and l.signal_type = 'tax_delinquent' group by l.id")
def surface_refresh(t):
    return leads.refreshing(t.listings.filter("distress_stage = 'distress_signal'"), t.signals, _RULE, t.now)


_TIERS = f", s as (select parcel_number, market, count(*) tickets, sum(balance) balance, bool_or(balance >= 2000) as large from signals where signal_type = 'blight_violation' and last_seen_at >= {T} - interval 21 day group by all), tiers as (select *, case when tickets >= 2 and balance >= 2000 then 'A' when tickets >= 2 and balance >= 500 then 'B' else 'C' end tier from s)"


@query(_TIERS + "select parcel_number, market, tickets, balance::double as balance, large, tier from tiers")
def tier_leads(t):
    return leads.blight_tiers(t.signals, t.now, fresh_days=21).withColumn("balance", F.col("balance").cast("double"))


@query(_TIERS + "select market, tier, count(*) as n from tiers group by all")
def tier_split(t):
    return leads.blight_tiers(t.signals, t.now, fresh_days=21).groupBy("market", "tier").agg(F.count("*").alias("n"))


# ---- folds and windows


@query("select parcel_number, max(sale_date) as last_sale_date, max(price) filter (sale_date = m)::double as last_sale_price from (select *, max(sale_date) over (partition by parcel_number) m from sales) group by parcel_number")
def latest_sale(t):
    return t.latest.withColumn("last_sale_price", F.col("last_sale_price").cast("double"))


@query("select p.parcel_number, p.market, d as last_sale_date from parcels p left join (select parcel_number, max(sale_date) d from sales group by 1) s using (parcel_number)")
def sales_overlay(t):
    return t.parcels.join(t.latest, "parcel_number", "left").select("parcel_number", "market", "last_sale_date")


@query("select parcel_number, sum(balance)::double as total, string_agg(distinct signal_type, ',' order by signal_type) as kinds, min(observed_at)::date as first_day, max(observed_at)::date as last_day from signals group by parcel_number")
def per_parcel_fold(t):
    return folding.fold_parcels(t.signals, "parcel_number", "balance", "signal_type", "observed_at").withColumn("total", F.col("total").cast("double"))


@query("select market, property_address, count(*) as n, string_agg(id, ',' order by first_seen, id) as ids from listings where property_address is not null group by all having count(*) > 1")
def same_address_duplicates(t):
    return folding.duplicates(t.listings.filter("property_address is not null"), ["market", "property_address"], "first_seen")


@query("select case_number, count(distinct parcel_number) as n from listings where case_number is not null group by 1 having count(distinct parcel_number) > 3")
def case_explosion(t):
    return folding.distinct_over(t.listings.filter("case_number is not null"), "case_number", "parcel_number", 3)


@query("select source_site, list_sort(list(found))[len(list(found)) // 2 + 1] as median from runs group by 1")
def run_upper_median(t):
    return folding.upper_median(t.runs, "source_site", "found")


@query("select id, signal_type from (select id, signal_type, row_number() over (partition by signal_type order by md5('7:' || id), id) r from listings) where r <= 25")
def stratified_sample(t):
    return sampling.lowest(t.listings.select("id", "signal_type"), 25, "id", stratum="signal_type")


@query("select distinct parcel_number, market from listings where parcel_number is not null union select distinct parcel_number, market from signals")
def target_union(t):
    keys = ["parcel_number", "market"]
    return t.listings.filter("parcel_number is not null").select(*keys).union(t.signals.select(*keys)).distinct()


# ---- resolution


@query(", k as (select owner_name as key, min(parcel_number) parcel from parcels where owner_name is not null group by 1 having count(distinct parcel_number) = 1) select s_suppkey as suppkey, k.parcel as resolved from supplier left join k on replace(s_name, 'Supplier', 'Customer') = k.key")
def unique_key_resolution(t):
    records = t.supplier.select(F.col("s_suppkey").alias("suppkey"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return resolving.resolve_unique(records, F.col("name"), t.parcels, F.col("owner_name")).select("suppkey", "resolved")


@query(", c as (select l.case_number, p.parcel_number from listings l join parcels p on l.property_city = p.property_city and l.market = p.market and split_part(l.property_address, ' ', 1) = split_part(p.situs_address, ' ', 1) where l.signal_type = 'probate' group by all) select case_number, parcel_number from c where case_number is not null and case_number in (select case_number from c group by 1 having count(distinct parcel_number) <= 1)")
def ambiguity_cap(t):
    """Candidates share house number and city; a case with more than one resolves to nothing."""
    house = lambda c: F.split_part(c, F.lit(" "), F.lit(1)).alias("house")
    cases = t.listings.filter("signal_type = 'probate' and case_number is not null").select("case_number", "property_city", "market", house("property_address"))
    pairs = cases.join(t.parcels.select("property_city", "market", "parcel_number", house("situs_address")), ["property_city", "market", "house"]).select("case_number", "parcel_number").distinct()
    return resolving.cap_ambiguous(pairs, "case_number", "parcel_number", cap=1)


@query(r"""
with o as (select p_name as owner, count(*) as parts, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as folded from part group by 1),
q as (select distinct translate(p_name, 't', 'd') as query, trim(regexp_replace(regexp_replace(lower(translate(p_name, 't', 'd')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as folded from part),
words as (select folded, i, w from (select folded, unnest(string_split(folded, ' ')) as w, generate_subscripts(string_split(folded, ' '), 1) as i from (select folded from o union select folded from q)) where length(w) >= 2 and upper(w) not in ('JR', 'SR', 'II', 'III', 'IV', 'V')),
alike as (select a.w as x, b.w as y, 1 - levenshtein(a.w, b.w)::double / greatest(length(a.w), length(b.w), 1) as s from (select distinct w from words) a join (select distinct w from words) b on 1 - levenshtein(a.w, b.w)::double / greatest(length(a.w), length(b.w), 1) >= 0.85),
best as (select a.folded as asked, a.i, b.folded as has, max(s) as s from words a join alike on a.w = x join words b on b.w = y where a.folded in (select folded from q) and b.folded in (select folded from o) group by 1, 2, 3),
pair as (select asked, has, round(sum(s) / count(*), 4) as confidence from best where asked <> has group by 1, 2 having count(*) >= 2 union all select q.folded, o.folded, 1.0 from q join o on q.folded = o.folded group by 1, 2)
select query, owner, parts, confidence from pair join q on asked = q.folded join o on has = o.folded where confidence >= 0.75""", prelude=False)
def fuzzy_name_join(t):
    people = t.part.groupBy(F.col("p_name").alias("owner")).agg(F.count("*").alias("parts"))
    wanted = t.part.select(F.translate("p_name", "t", "d").alias("query")).distinct()
    return resolving.fuzzy_name_join(wanted, people, query="query", owner="owner")


@query("select k, coalesce(nullif(a.name, ''), b.name) as name, coalesce(nullif(a.bal, 0), b.bal)::double as bal from (select c_custkey * 2 k, case when c_custkey % 3 <> 0 then c_name else '' end as name, case when c_custkey % 4 = 0 then 0 else c_acctbal end bal from customer) a full join (select s_suppkey k, s_name as name, nullif(s_acctbal, 0) bal from supplier) b using (k)", prelude=False)
def two_reader_merge(t):
    a = t.customer.select((F.col("c_custkey") * 2).alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("name"), F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("bal"))
    return resolving.merge_readers(a, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")), "k")


_SURVEY = "(select c_custkey * 3 k, c_custkey % 5 as grade from customer)"


@query(f"select l.k, s.grade, 'live' as origin from (select s_suppkey k from supplier) l left join {_SURVEY} s using (k) union all select k, grade, 'survey' from {_SURVEY} where k not in (select s_suppkey from supplier)", prelude=False)
def live_survey_anti(t):
    survey = t.customer.select((F.col("c_custkey") * 3).alias("k"), (F.col("c_custkey") % 5).alias("grade"))
    return resolving.live_and_survey(t.supplier.select(F.col("s_suppkey").alias("k")), survey, "k")


# ---- audits


@query("select source_site, before, found, round((before - found) / before, 4) as drop_share from (select *, lead(found) over w before, row_number() over w r from runs where status = 'success' window w as (partition by source_site order by started_at desc)) where r = 1 and before >= 2 and before - found > 0.4 * before")
def collapse_guard(t):
    return audits.collapses(t.runs, least=2)


@query(f", recent as (select * from runs where started_at >= {T} - interval 75 day) select l.source_site, u.median, u.runs from (select source_site, arg_max(found, started_at) found from recent group by 1) l join (select source_site, median(found) median, count(*) runs from recent where status = 'success' and found > 0 group by 1) u using (source_site) where l.found = 0 and u.median >= 1 and u.runs >= 2")
def zero_yield(t):
    return audits.zero_yields(t.runs, t.now, least=1.0)


@query("select source_site, count(*) filter (hits = 0) as zero_runs from (select source_site, sum((found > 0)::int) over (partition by source_site order by started_at desc rows unbounded preceding) hits from runs) group by 1")
def run_collapse(t):
    return audits.trailing_zero_runs(t.runs)


@query(f"select id, market, sale_date, date_diff('day', sale_date, {D}) as days_over from listings where status = 'active' and sale_date < {D}")
def quality_past_sale(t):
    return audits.stale_active(t.listings, t.as_of)


@query("select id, concat_ws('; ', case when property_address is null then 'no address' end, case when parcel_number is null then 'no parcel' end) as reasons from listings where property_address is null or parcel_number is null")
def quality_address(t):
    return audits.address_reasons(t.listings)


@query("select coalesce(match_confidence, 'NULL') as tier, case when split_part(upper(case_status), ' - ', 1) = 'CLOSED' then 'closed' when case_status is null then 'unknown' else 'open' end as state, count(*) as n from listings where signal_type = 'probate' group by all")
def quality_probate(t):
    return audits.probate_validity(t.listings)


@query("select source_site, found, active, round(abs(active - found) / found, 4) as drift from runs where found > 0 and abs(active - found) / found > 0.15 and (source_site, started_at) in (select source_site, max(started_at) from runs group by 1)")
def quality_coverage(t):
    return audits.coverage_drift(t.runs)


@query("select market, signal_type, count(*) as n from (select * replace (case when id % 7 = 0 then 'lost' else market end as market) from signals) s where not exists (select 1 from parcels p where p.parcel_number = s.parcel_number and p.market = s.market) group by all")
def quality_orphans(t):
    """A seventh of the signals came under a market that lacks their parcel."""
    return audits.orphan_signals(t.signals.withColumn("market", F.when(F.col("id") % 7 == 0, "lost").otherwise(F.col("market"))), t.parcels)


@query("select id, parcel_number, market from listings l where distress_stage = 'distress_signal' and status = 'active' and exists (select 1 from listings b where b.distress_stage = 'buy_now' and b.status = 'active' and b.parcel_number = l.parcel_number and b.market = l.market)")
def quality_overlap(t):
    return audits.lead_overlap(t.listings)


@query("select id, parcel_number, first_seen, d as last_sale_date from listings join (select parcel_number, max(sale_date) d from sales group by 1) using (parcel_number) where status = 'active' and d > first_seen")
def quality_transfer(t):
    return audits.transfer_breaches(t.listings, t.latest).drop("last_sale_price")


@query(f""", l as (select count(*) listings, count(*) filter (status = 'active') active, count(*) filter (status = 'expired') expired, count(*) filter (distress_stage = 'distress_signal') leads, count(*) filter (parcel_number is null) no_parcel, count(*) filter (property_address is null) no_address,
  count(*) filter (status = 'active' and sale_date < {D}) past_sale_active, count(*) filter (signal_type is null) no_type from listings), s as (select count(*) signals, count(*) filter (market is null) signals_no_market from signals), p as (select count(*) parcels, count(*) filter (owner_name is null) parcels_no_owner from parcels)
select name as metric, value as n from (unpivot l on columns(*) into name name value value) union all select name, value from (unpivot s on columns(*) into name name value value) union all select name, value from (unpivot p on columns(*) into name name value value)""")
def health_snapshot(t):
    return audits.health(t.listings, t.signals, t.parcels, t.as_of)


@query(f"select id, date_diff('day', first_seen, {D}) as age_days, case when coalesce(sale_date < {D} or coalesce(case_status ilike 'closed%', false), false) then 'STALE' when property_address is null or parcel_number is null or coalesce(match_confidence, 'confirmed') in ('review', 'unverified') then 'REVIEW' else 'VALID' end as verdict from listings where status = 'active'")
def verification_verdicts(t):
    return audits.verdicts(t.listings, t.as_of)


# ---- scalar functions over whole tables


@query("select o_orderkey as k, case o_orderkey % 8 when 3 then '0' || right(d, 6) when 4 then right(d, 7) when 5 then '67' || right(d, 5) when 6 then 'UNKNOWN-PARCEL' when 7 then null else d[1:3] || '-' || d[4:5] || '-' || d[6:8] end as parcel from (select *, lpad(o_custkey::varchar, 8, '1') d from orders)", prelude=False)
def parcel_normalize(t):
    """Parcels as they land: eight digits, with blanks around, dashed, short, seven digits, in another form, and no number at all."""
    digits = F.lpad(F.col("o_custkey").cast("string"), 8, "1")
    forms = [digits, F.concat(F.lit("  "), digits, F.lit(" ")), F.concat_ws("-", F.left(digits, F.lit(3)), F.substring(digits, 4, 2), F.right(digits, F.lit(3))), F.right(digits, F.lit(6)), F.right(digits, F.lit(7)), F.concat(F.lit("67-"), F.right(digits, F.lit(5))), F.lit("UNKNOWN-PARCEL"), F.lit(" ")]
    return t.orders.select(F.col("o_orderkey").alias("k"), parcels.parcel_number(F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int"))).alias("parcel"))


@query("select id, replace(regexp_replace(property_address, ' STREET$', ' St'), 'NATION', 'Nation') as address, regexp_replace(regexp_replace(lower(property_address), '_', '', 'g'), 'street$', 'st') as key from listings")
def address_canonical(t):
    a = F.col("property_address")
    return t.listings.select("id", addresses.canonical_address(a).alias("address"), addresses.match_address(a).alias("key"))


@query("select l_orderkey as k, l_linenumber as line, nullif(round(l_extendedprice, 2), 0)::double as price, l_shipdate::date as day from lineitem", prelude=False)
def money_and_date_parse(t):
    text = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), values.money(text).cast("double").alias("price"), values.any_date(F.date_format("l_shipdate", "M/d/yyyy")).alias("day"))


@query("select c_custkey as k, 'Nation_' || c_nationkey as city, lpad((c_custkey % 100000)::varchar, 5, '0') as zip, c_custkey % 2 = 1 as absent from customer", prelude=False)
def city_zip(t):
    """Owners of odd numbers get their mail in the next zip, so it is another one whatever the zip."""
    zip_of = lambda k: F.lpad((k % 100000).cast("string"), 5, "0")
    k = F.col("c_custkey")
    mail = F.concat(F.lit("1 A ST, OH "), zip_of(F.when(k % 2 == 1, k + 1).otherwise(k)))
    place = F.concat(F.lit("1 A ST, OH "), zip_of(k), F.lit("-1234"))
    return t.customer.select(k.alias("k"), addresses.canonical_city(F.concat(F.lit(" NATION_"), F.col("c_nationkey").cast("string"))).alias("city"), addresses.zip5(place).alias("zip"), addresses.absentee(mail, place).alias("absent"))


@query("select event_id as id, json_extract(props, '$.k')::int as k, json_extract(props, '$.k')::int >= 50 as passes from events where json_extract(props, '$.k') is not null", prelude=False)
def json_gate(t):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    return t.events.select(F.col("event_id").alias("id"), k.alias("k"), (k >= 50).alias("passes")).filter("k is not null")


@query("select source_site, market, status, count(*) as n, sum(opening_bid_usd)::double as bids from listings group by rollup (source_site, market, status)")
def run_totals_rollup(t):
    return t.listings.rollup("source_site", "market", "status").agg(F.count("*").alias("n"), F.sum("opening_bid_usd").cast("double").alias("bids"))


from ledgerfold.plans import batches, further, ingest, more, rows, streams  # noqa: E402,F401  register more queries
