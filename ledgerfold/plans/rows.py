"""Queries of the listing's row, its links, readers that are merged, folds and filters of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import addresses
from ledgerfold.operators import items, leads, merging, readers
from ledgerfold.plans.registry import _ENTITY, _LABEL, _STACK, D, query
from ledgerfold.sources import property_pages as pp

_WIDE = """
, wl as (select l.*, case when orderkey % 6 = 0 then property_address || ' #3/4 ~*é, ' || property_city || ', OH' else property_address end as address, case when orderkey % 4 > 0 then lpad((orderkey % 99999)::varchar, 5, '0') end as zip, case when orderkey % 8 > 0 then property_city else '' end as city from listings l),
 wp as (select *, case when custkey % 3 = 0 then '0' || custkey || '  00/15' when custkey % 3 = 1 then '' end as native, case when custkey % 4 = 0 then null else custkey % 4 = 1 end as flag, case when custkey % 6 > 0 then custkey * 10.5 end::decimal(18,2) as market_value from parcels)"""
_QUOTE = "replace(replace(url_encode({0}), '%2F', '/'), '+', '%20')"


@query(_STACK + _WIDE + f"""
, e as (select wl.*, wp.owner_name as known_owner, wp.situs_address as situs, wp.native, wp.flag, wp.market_value, wp.current_tax_balance as tax, s.signal_count as n, s.types, case when contains(address, ',') then address else concat_ws(', ', nullif(address, ''), nullif(city, ''), wl.property_state, zip) end as whole
  from wl left join wp on wl.parcel_number = wp.parcel_number and wl.market = wp.market left join stacked s on wl.parcel_number = s.parcel_number and wl.market = s.market),
lab as (select id, label, min(ord) ord, arg_min(n, ord) n from (select id, {_LABEL.format("signal_type")} label, 0 ord, 1::bigint n from listings
    union all select id, {_LABEL.format("types[k].t")}, k, types[k].n from (select id, types, unnest(generate_series(1, len(types))) k from e where types is not null)) where label is not null group by id, label),
chip as (select id, string_agg(label || '=' || n, ',' order by ord) chips, count(*)::int dimensions from lab group by id)
select e.id, source_site, signal_type, address as property_address, city as property_city, property_state, zip as property_zip, status, sale_date, opening_bid_usd::double as opening_bid_usd, case_number, parcel_number as source_listing_id, distress_stage, case_status, match_confidence,
  (orderkey % 10000 / 10000)::double as match_score, case when orderkey % 5 < 3 then orderkey % 5 = 0 end as absentee_owner, redemption_status, first_seen::timestamp as first_seen_at, last_seen::timestamp as last_seen_at, coalesce(n, 0) as signal_count, coalesce(chips, '') as chips, coalesce(dimensions, 0) as signal_type_count,
  coalesce(dimensions, 0) >= 2 as is_hot, coalesce(known_owner, '(Owner not found)') as owner_name, known_owner is not null as registry_confirmed, {_ENTITY.replace("owner_name", "known_owner")} as owner_is_entity, situs as situs_address, market_value::double as current_market_value, tax::double as current_tax_balance, coalesce(flag, false) as delinquent_flag,
  case when address is not null then 'https://maps.googleapis.com/maps/api/streetview?size=600x400&location=' || replace(replace(url_encode(concat_ws(', ', address, nullif(city, ''), property_state, zip)), '%20', '+'), '*', '%2A') || '&pitch=10&source=outdoor&key=K' end as street_view_url,
  case when address is not null then 'https://www.zillow.com/homes/' || {_QUOTE.format("whole")} || '_rb/' end as zillow, case when address is not null then 'https://www.google.com/search?q=' || {_QUOTE.format("'site:redfin.com ' || whole")} end as redfin,
  case property_state when 'TN' then case when native <> '' then 'https://apps2.shelbycountytrustee.com/Parcel?parcel=' || replace(url_encode(native), '+', '%20') else 'https://apps2.shelbycountytrustee.com/PropertyClient' end
    when 'OH' then case when parcel_number is not null then 'https://myplace.cuyahogacounty.gov/?parcel=' || parcel_number else 'https://myplace.cuyahogacounty.gov/' end end as registry,
  case property_state when 'TN' then 'Shelby Trustee' when 'OH' then 'Cuyahoga MyPlace' else 'County Registry' end as registry_label, case source_site when 'site_1' then 'https://one.example.com/' when 'site_2' then 'https://two.example.com/' end as source,
  null::varchar as trustee_name, null::double as deposit_usd
from e left join chip using (id)""")
def listing_items(t):
    """All listings as items: addresses that are whole already and have signs, blank cities, missing zips, parcels and native numbers, unknown flags."""
    k, c = F.col("orderkey"), F.col("custkey")
    listings = t.listings.withColumns({
        "property_address": F.when(k % 6 == 0, F.concat("property_address", F.lit(" #3/4 ~*é, "), "property_city", F.lit(", OH"))).otherwise(F.col("property_address")), "property_zip": F.when(k % 4 > 0, F.lpad((k % 99999).cast("string"), 5, "0")),
        "property_city": F.when(k % 8 > 0, F.col("property_city")).otherwise(""), "source_listing_id": F.col("parcel_number"), "match_score": k % 10000 / 10000, "absentee_owner": F.when(k % 5 < 3, k % 5 == 0), "first_seen_at": F.col("first_seen"), "last_seen_at": F.col("last_seen"),
    })
    parcels = t.parcels.withColumns({
        "native_parcel_id": F.when(c % 3 == 0, F.concat(F.lit("0"), c.cast("string"), F.lit("  00/15"))).when(c % 3 == 1, ""), "delinquent_flag": F.when(c % 4 > 0, c % 4 == 1), "current_market_value": F.when(c % 6 > 0, c * 10.5),
    })
    rows = items.items(items.base_rows(listings, parcels, t.signals), {"site_1": "https://one.example.com/", "site_2": "https://two.example.com/", "site_3": None}, key="K")
    text = F.array_join(F.transform("signal_types", lambda x: F.concat(x["label"], F.lit("="), x["count"].cast("string"))), ",").alias("chips")
    shown = ["id", "source_site", "signal_type", "property_address", "property_city", "property_state", "property_zip", "status", "sale_date", "opening_bid_usd", "case_number", "source_listing_id", "distress_stage", "case_status", "match_confidence", "match_score", "absentee_owner"]
    shown += ["redemption_status", "first_seen_at", "last_seen_at", "signal_count", "signal_type_count", "is_hot", "owner_name", "registry_confirmed", "owner_is_entity", "situs_address", "current_market_value", "current_tax_balance", "delinquent_flag", "street_view_url", "trustee_name", "deposit_usd"]
    return rows.select(*shown, text, "verify_links.*")


_PAIRS = """
with a as (select o_orderkey as seq, case when o_custkey % 9 > 0 then 'K' || (o_custkey % 400) end as k, case when o_orderkey % 3 = 0 then 0 else o_totalprice end::double as bid, case when o_orderkey % 4 > 0 then o_orderdate::date end as day, case when o_orderkey % 5 = 0 then '' else o_orderpriority end as place, o_orderkey % 50 = 0 as flag, 'first ' || o_orderkey as vendor from orders where o_orderkey % 2 = 0),
 b as (select o_orderkey as seq, 'K' || (o_custkey % 500) as k, o_totalprice::double as bid, o_orderdate::date as day, o_orderpriority as place, null::boolean as flag, 'second ' || o_orderkey as vendor from orders where o_orderkey % 2 = 1),
 p as (select distinct 'K' || (c_custkey % 400) as key, 'P' || (c_custkey % 100) as parcel from customer where c_custkey % 400 < 200),
 u as (select *, 1 as r from a union all select *, 2 from b),
 g as (select u.*, p.parcel, coalesce('parcel:' || p.parcel, 'addr:' || k, 'raw:' || r || ':' || seq) as group_key, {'r': r, 's': seq} as o from u left join p on u.k = p.key)"""


@query(_PAIRS + """
select group_key, arg_min(parcel, o) as parcel, arg_min(seq, o) as seq, coalesce(arg_min(bid, o) filter (coalesce(bid, 0) <> 0), arg_min(bid, o)) as bid, arg_min(day, o) filter (day is not null) as day, coalesce(arg_min(place, o) filter (place <> ''), arg_min(place, o)) as place, coalesce(bool_or(flag), false) as flag, arg_min(vendor, o) as vendor
from g group by 1""", prelude=False)
def readers_by_place(t):
    """Even orders are one reader, odd ones the other; addresses lead to a parcel that two or more of them share, or to none, and some rows have no address."""
    o, key, c = t.orders, F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    k = lambda n: F.concat(F.lit("K"), (c % n).cast("string"))
    first = o.filter(key % 2 == 0).select(
        key.alias("seq"), F.when(c % 9 > 0, k(400)).otherwise("").alias("k"), F.when(key % 3 == 0, 0).otherwise(F.col("o_totalprice")).cast("double").alias("bid"), F.when(key % 4 > 0, day).alias("day"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("place"), (key % 50 == 0).alias("flag"), F.concat(F.lit("first "), key.cast("string")).alias("vendor"),
    )
    second = o.filter(key % 2 == 1).select(key.alias("seq"), k(500).alias("k"), F.col("o_totalprice").cast("double").alias("bid"), day.alias("day"), F.col("o_orderpriority").alias("place"), F.concat(F.lit("second "), key.cast("string")).alias("vendor"))
    n = F.col("c_custkey")
    parcels = t.customer.filter(n % 400 < 200).select(F.concat(F.lit("K"), (n % 400).cast("string")).alias("key"), F.concat(F.lit("P"), (n % 100).cast("string")).alias("parcel"))
    return readers.merge_by_place(first, second, parcels, key="k", order="seq", fill=["bid", "day", "place"], any_of=["flag"]).drop("k")


@query("""
with r as (select case when o_orderkey % 40 = 0 then ' ' else 'P' || o_custkey end as parcel, o_orderkey as seq, case when o_orderkey % 3 > 0 then 'OWNER ' || (o_orderkey % 10) end as owner, case when o_orderkey % 4 = 0 then 'n/a' else year(o_orderdate::date)::varchar end as y, case when o_orderkey % 5 > 0 then o_totalprice end as unpaid, case when o_orderkey % 6 = 0 then ' ' else ' ' || o_orderpriority end as authority from orders)
select parcel, arg_min({'o': owner}, seq).o as owner, arg_min(owner, seq) filter (owner is not null) as first_owner, coalesce(sum(unpaid), 0)::double as unpaid, coalesce(string_agg(distinct nullif(trim(authority), ''), ',' order by nullif(trim(authority), '')), '') as authorities, string_agg(distinct coalesce(try_cast(y as int), 2020)::varchar, ',' order by coalesce(try_cast(y as int), 2020)::varchar) as years,
  make_date(max(coalesce(try_cast(y as int), 2020))::int, 1, 1) as observed from r where trim(parcel) <> '' group by 1""", prelude=False)
def tape_fold(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        F.when(k % 40 == 0, " ").otherwise(F.concat(F.lit("P"), F.col("o_custkey").cast("string"))).alias("parcel"), k.alias("seq"), F.when(k % 3 > 0, F.concat(F.lit("OWNER "), (k % 10).cast("string"))).alias("owner"),
        F.when(k % 4 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string")).alias("y"), F.when(k % 5 > 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("unpaid"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("authority"),
    )
    out = readers.fold_tape(rows, "parcel", "seq", year="y", unpaid="unpaid", authority="authority", keep=["owner"], fallback_year=2020)
    return out.select("parcel", "owner", "first_owner", F.col("unpaid").cast("double").alias("unpaid"), F.array_join("authorities", ",").alias("authorities"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "observed")


@query("select l.case_number, count(distinct upper(trim(owner_name))) as owners from (select *, case orderkey % 4 when 0 then 'composite' when 1 then 'name_match' end as method from listings) l join parcels p on l.parcel_number = p.parcel_number and l.market = p.market where coalesce(method, '') not in ('composite', 'address_anchor') and case_number is not null group by 1 having count(distinct upper(trim(owner_name))) > 2")
def owner_explosions(t):
    rows = t.listings.withColumn("match_method", F.when(F.col("orderkey") % 4 == 0, "composite").when(F.col("orderkey") % 4 == 1, "name_match")).join(t.parcels.select("parcel_number", "market", "owner_name"), ["parcel_number", "market"])
    return readers.owner_explosions(rows, cap=2)


@query(f"""
, v as (select l.*, p.owner_name, s.d, s.price, p.custkey * 100.5 as mv, case when orderkey % 7 = 0 then 'in_redemption' end as auction, case when orderkey % 5 = 0 then null else date_diff('day', first_seen, {D}) end as age, coalesce(nullif(match_confidence, ''), 'legacy') as tier, coalesce(signal_type, '') = 'probate' as prob, coalesce(sale_date < {D}, false) as past
  from listings l left join parcels p on l.parcel_number = p.parcel_number and l.market = p.market left join (select parcel_number, max(sale_date) d, arg_max(price, {{'d': sale_date, 'p': price}}) price from sales group by 1) s on l.parcel_number = s.parcel_number),
 w as (select *, case when status is distinct from 'active' then 'status=' || coalesce(status, 'None') when past and auction is null then 'sale_date in past' when prob and regexp_matches(coalesce(case_status, ''), '(?i)closed|dismissed|terminated') then 'case ' || case_status
  when prob and regexp_matches(coalesce(case_number, ''), '^[0-9]{{4}}') and coalesce(year(d) >= try_cast(left(case_number, 4) as int), false) then 'TRANSFERRED - parcel sold ' || d || case when coalesce(price, 0) <> 0 then ' for $' || format('{{:,}}', floor(price)::bigint) else '' end || ' (case filed ' || left(case_number, 4) || ')' end as stale from v)
select id, case when stale is not null then 'STALE' when (prob and tier = 'unverified') or owner_name is null then 'REVIEW' else 'VALID' end as verdict,
  coalesce(stale, concat_ws(' | ', case when past then 'in redemption - live lead, sale_date past is expected' end, case when owner_name is not null then 'parcel real (owner: ' || owner_name || ', mv=$' || format('{{:,}}', coalesce(floor(mv)::bigint, 0)) || ')' else 'NO parcel registry match - confirm address' end,
   case when prob then 'match=' || tier end, case when prob and tier = 'unverified' then 'name-only fuzzy join - verify owner==decedent' end, case when prob and age is not null then 'lead age: ' || age || 'd' end)) as notes from w""")
def verdict_notes(t):
    k = F.col("orderkey")
    rows = t.listings.join(t.parcels.select("parcel_number", "market", "owner_name", (F.col("custkey") * 100.5).alias("current_market_value")), ["parcel_number", "market"], "left").join(t.latest, "parcel_number", "left")
    rows = rows.withColumns({"auction_status": F.when(k % 7 == 0, "in_redemption"), "lead_age_days": F.when(k % 5 > 0, F.datediff(t.as_of, "first_seen"))})
    return readers.verdict_with_notes(rows, t.as_of).select("id", "verdict", F.array_join("notes", " | ").alias("notes"))


@query(f"""
select o_orderkey as k, concat_ws(',', case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 'for sale' end, case when upper(trim(' ' || case o_orderstatus when 'O' then 'active' when 'F' then 'closed' end)) = 'ACTIVE' then 'active' end, case when coalesce(case o_orderstatus when 'P' then 'rm' when 'F' then 'OK' end, '') <> 'rm' then 'not removed' end,
  case when coalesce(case when o_orderkey % 3 > 0 then o_orderkey % 3 - 1 end, 0) = 0 then 'not redeemed' end, case when o_orderpriority in ('2-HIGH', '3-MEDIUM') and o_orderpriority not in ('3-MEDIUM') then 'program' end, case when n_regionkey = 1 and n_nationkey % 2 = 1 then 'county' end, case when coalesce(case when o_orderkey % 11 > 0 then o_orderkey % 11 end < 5, true) then 'small' end,
  case when coalesce(case when o_orderkey % 13 > 0 then o_orderdate::date end >= {D} - 90, true) then 'recent' end, case when year(o_orderdate::date) >= 1997 then 'year' end, case when left(o_orderstatus, 1) in ('O', 'F') then 'letter' end) as taken
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""", prelude=False)
def source_filters(t):
    """Which of the filters of single sources each order passes, its columns taken for theirs."""
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.to_date("o_orderdate")
    tests = {
        "for sale": readers.for_sale(F.when(priority == "1-URGENT", "FOR SALE").otherwise(priority), F.when(status == "O", "Y").otherwise("N")), "active": readers.case_active(F.when(status == "O", " active").when(status == "F", "closed")),
        "not removed": readers.not_removed(F.when(status == "P", " rm").when(status == "F", "OK")), "not redeemed": readers.not_redeemed(F.when(k % 3 > 0, k % 3 - 1)), "program": readers.in_program(priority, ["2-HIGH", "3-MEDIUM"], ["3-MEDIUM"]),
        "county": readers.in_county(F.when(F.col("n_regionkey") == 1, " mi"), F.when(F.col("n_nationkey") % 2 == 1, "Wayne "), ("MI", "WAYNE")), "small": readers.small_building(F.when(k % 11 > 0, k % 11)), "recent": readers.recent_notice(F.when(k % 13 > 0, day), t.as_of),
        "year": readers.from_last_year(F.year(day), t.as_of), "letter": readers.of_counties(F.concat(F.lit(" "), F.lower(status)), "OF"),
    }
    return rows.select(k.alias("k"), F.concat_ws(",", *[F.when(v, name) for name, v in tests.items()]).alias("taken"))


@query("select parcel_number, price, day from (select p.parcel_number, s.price::double as price, s.day, case when custkey % 2 = 0 then custkey * 10 end::double as old_price, date '1995-01-01' as old_day from parcels p join (select parcel_number, case when max(price) > 60000 then max(price) end::double price, max(sale_date) as day from sales group by 1) s using (parcel_number)) where price is distinct from old_price or day is distinct from old_day")
def overlay_overwriting(t):
    """Here an unknown new price replaces the old one."""
    old = t.parcels.select("parcel_number", F.when(F.col("custkey") % 2 == 0, F.col("custkey") * 10).cast("double").alias("price"), F.lit("1995-01-01").cast("date").alias("day"))
    new = t.sales.groupBy("parcel_number").agg(F.when(F.max("price") > 60000, F.max("price")).cast("double").alias("price"), F.max("sale_date").alias("day"))
    return merging.overlay_changed(old, new, "parcel_number", ["price", "day"], keep_old=False)


@query("""
select o_orderkey as k, 'LOT ' || o_custkey || ' & ' || o_orderkey as legal_description, case when o_orderkey % 3 > 0 then (o_custkey % 9000 + 1000)::varchar end as land_use_code, case when o_orderkey % 3 > 0 then '1-FAMILY' end as land_use_description, case when o_orderkey % 4 = 0 then 'PUBLIC' end as util_water, case when o_orderkey % 4 = 0 then null when o_orderkey % 2 = 0 then 'YES' end as util_gas,
  o_orderkey % 5 > 0 as present, case when o_orderkey % 5 > 0 then greatest(o_orderdate::date, date '1994-03-04') end as last_date, case when o_orderkey % 5 > 0 then o_custkey * 1000.5 end::double as last_price, case when o_orderkey % 5 > 0 then 2 else 0 end as transfers from orders""", prelude=False)
def property_pages(t):
    """Orders as pages of a property register: labels with and without values, codes with descriptions, histories with and without transfers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    p = lambda *xs: F.concat(*[F.concat(F.lit("<p>"), x if not isinstance(x, str) else F.lit(x), F.lit("</p>")) for x in xs])
    use = F.when(k % 3 > 0, F.concat(text(c % 9000 + 1000), F.lit(" - 1-FAMILY"))).otherwise("Top")
    tail = F.when(k % 4 == 0, p("Gas", "Water", "PUBLIC")).when(k % 2 == 0, p("Water", "Gas", "YES")).otherwise(p("Water", "Gas", "Sewer", "View Map"))
    history = F.when(k % 5 == 0, p("No Information Found", "1/1/1999")).otherwise(F.concat(p(F.concat(F.lit("Transfer Date: "), F.date_format("o_orderdate", "M/d/yyyy"))), p(F.concat(F.lit("Sales Amt: $"), F.format_number(c * 1000.5, 2))), p("Transfer Date: 3/4/1994", "Sales Amt: $7")))
    page = F.concat(F.lit('<h1>Gas</h1><p>1/2/2003</p><div class="dataBody">'), p("Description", F.concat(F.lit("LOT "), text(c), F.lit(" &amp; "), text(k)), "Land Use"), p(use), tail, F.lit("</div><h3>Transfer History</h3>"), history)
    pages = t.orders.select(k.alias("k"), page.alias("page"))
    read = pages.select("k", pp.label_values(F.col("page")).alias("f"), pp.transfer_history(F.col("page")).alias("h"))
    return read.select("k", *[f"f.{c}" for c in ("legal_description", "land_use_code", "land_use_description", "util_water", "util_gas")], "h.*")


@query(f"""
with d as (select distinct o_orderdate::date as day from orders) select day, case dayofweek(day) when 5 then 'mortgage_foreclosure' else 'tax_delinquent_foreclosure' end as signal_type from d where day >= {D} and dayofweek(day) in (2, 5) and day(day) % 3 > 0""", prelude=False)
def sale_calendar(t):
    """A calendar a month, with an entry on the days that have orders but for every third."""
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    cell = F.concat(F.lit("<div class='CALBOX' dayid='"), F.date_format("day", "MM/dd/yyyy"), F.lit("'>"), F.when(F.dayofmonth("day") % 3 > 0, "<span class='CALTEXT'>Sale</span>").otherwise("&nbsp;"), F.lit("</div>"))
    months = days.groupBy(F.trunc("day", "month").alias("month")).agg(F.array_join(F.array_sort(F.collect_list(cell)), "\n").alias("page"))  # a month has at most 31 cells
    return months.select(F.explode(pp.calendar_sales(F.col("page"), t.as_of)).alias("s")).select("s.*")


@query("select n_nationkey as k, 'São ' || n_name || ' & Söhne''s' as city, upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' ½' as county from nation", prelude=False)
def entity_names(t):
    city = F.concat(F.lit(" s&atilde;o  "), "n_name", F.lit(" &AMP s&#xF6;hne&apos;s"))
    nation = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 99)))
    same = F.replace(addresses.canonical_city(city), nation, F.col("n_name"))
    return t.nation.select(F.col("n_nationkey").alias("k"), same.alias("city"), addresses.canonical_county(F.concat("n_name", F.lit(" &frac12; COUNTY "))).alias("county"))


@query("""
, x as (select s.id, p.owner_name as owner, s.id % 2 = 0 as spine, case when s.id % 3 > 0 then p.situs_address || ', ' || case when s.id % 4 < 2 then 'OAK' else replace(p.property_city, '_', ' no ') end || ' park, OH 4' || lpad((s.id % 9999)::varchar, 4, '0') || case when s.id % 5 = 0 then '-1234 ' else '' end when s.id % 3 = 0 then '' end as place, 'OWNER ' || s.id as told
  from signals s join parcels p on s.parcel_number = p.parcel_number and s.market = p.market)
select id, case when spine then coalesce(nullif(place, ''), 'at ' || id) else coalesce(place, '') end as address, case when place <> '' and id % 4 < 2 then 'Oak Park' end as city, case when place <> '' then '4' || lpad((id % 9999)::varchar, 4, '0') end as zip, case when spine then coalesce(owner, told) else told end as owner from x""")
def lead_projection(t):
    """Even signals take their parcel's address, odd ones what the payload says; cities with digits are none."""
    k = F.col("id")
    joined = t.signals.select("id", "parcel_number", "market").join(t.parcels.select("parcel_number", "market", "situs_address", "owner_name", "property_city"), ["parcel_number", "market"])
    place = F.when(k % 3 > 0, F.concat("situs_address", F.lit(", "), F.when(k % 4 < 2, "OAK").otherwise(F.replace("property_city", F.lit("_"), F.lit(" no "))), F.lit(" park, OH 4"), F.lpad((k % 9999).cast("string"), 4, "0"), F.when(k % 5 == 0, "-1234 ").otherwise(""))).otherwise("")
    told = F.when(k % 2 == 0, F.concat(F.lit("at "), k.cast("string"))).otherwise(F.coalesce(place, F.lit("")))
    rows = joined.withColumns({"place": place, "payload": F.to_json(F.struct(told.alias("property_location"), F.concat(F.lit("OWNER "), k.cast("string")).alias("name")))})
    spine, payload = (leads.lead_fragments(leads.LeadSource(s, "OH", owner_key="name"), F.col("payload"), F.col("place"), F.col("owner_name")) for s in ("spine", "payload"))
    return rows.select("id", *[F.when(k % 2 == 0, spine[c]).otherwise(payload[c]).alias(c) for c in ("address", "city", "zip", "owner")])


@query("""
, r as (select l.*, p.owner_name, case orderkey % 5 when 0 then 'composite' when 1 then 'address_anchor' when 2 then 'name_match' end as method, case orderkey % 7 when 0 then null when 1 then ' ' when 2 then upper(p.owner_name) else 'someone else' end as decedent, orderkey % 9 as case_count, orderkey % 11 = 0 as explosion, orderkey % 100 / 100 as match_score
  from listings l left join parcels p on l.parcel_number = p.parcel_number and l.market = p.market),
 k as (select *, coalesce(method, '') in ('composite', 'address_anchor') as anchored, trim(coalesce(decedent, '')) <> '' and trim(coalesce(owner_name, '')) <> '' as known, lower(decedent) = lower(owner_name) as agree, case_count > 5 as many from r),
 a as (select *, case when anchored then case when many and not known then 'hide' when many and not agree then 'retire' when match_confidence = 'confirmed' then 'noop' else 'keep_confirmed' end
   when explosion then 'retire' when not known then case when many then 'retire' when match_confidence = 'unverified' then 'noop' else 'hide' end when not agree then 'retire' else 'retier' end as action from k)
select id, action, case action when 'keep_confirmed' then 'confirmed' when 'retier' then 'probable' when 'hide' then 'unverified' when 'noop' then match_confidence end as new_confidence, case action when 'keep_confirmed' then greatest(match_score, 0.95) when 'retier' then 1.0 end::double as new_score from a""")
def reresolution(t):
    k = F.col("orderkey")
    rows = t.listings.join(t.parcels.select("parcel_number", "market", "owner_name"), ["parcel_number", "market"], "left").withColumns({
        "match_method": F.when(k % 5 == 0, "composite").when(k % 5 == 1, "address_anchor").when(k % 5 == 2, "name_match"), "decedent_name": F.when(k % 7 == 1, " ").when(k % 7 == 2, F.upper("owner_name")).when(k % 7 > 2, "someone else"),
        "case_count": k % 9, "explosion": k % 11 == 0, "match_score": k % 100 / 100,
    })
    return readers.reresolve(rows).select("id", "action", "new_confidence", "new_score")
