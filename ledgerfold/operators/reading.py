"""The read path: signal stacking, enrichment, filters, pages, details and source cards."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions.names import is_entity
from ledgerfold.functions.values import dimension

VISIBLE_CONFIDENCE = ["confirmed", "probable", "review"]
CLOSED_WORDS = ["closed", "dismissed", "terminated"]
SORT_KEYS = {"first_seen": "first_seen", "sale_date": "sale_date", "opening_bid": "opening_bid_usd", "address": "property_address", "property_address": "property_address"}


def stack_signals(signals: DataFrame, keys: tuple[str, ...] = ("parcel_number", "market")) -> DataFrame:
    """Per parcel: ``signal_count`` and ``type_counts``, an array of (type, n) with shorter types first. Two pre-aggregated steps."""
    by_type = signals.groupBy(*keys, "signal_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("signal_type").isNotNull(), F.struct(F.length("signal_type").alias("size"), F.col("signal_type").alias("type"), "n"))))
    return by_type.groupBy(*keys).agg(F.sum("n").alias("signal_count"), F.transform(entries, lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("type_counts"))


def chips(own_type: Column, type_counts: Column) -> Column:
    """Distinct dimensions as (label, count): the listing's own first with count 1, then each stacked type whose label is new."""
    own = dimension(own_type)
    start = F.when(own.isNotNull(), F.array(F.struct(own.alias("label"), F.lit(1).cast("long").alias("count")))).otherwise(F.array().cast("array<struct<label:string,count:bigint>>"))
    labelled = F.transform(F.coalesce(type_counts, F.array().cast("array<struct<type:string,n:bigint>>")), lambda x: F.struct(dimension(x["type"]).alias("label"), x["n"].cast("long").alias("count")))
    fresh = lambda acc, x: x["label"].isNotNull() & ~F.exists(acc, lambda y: y["label"] == x["label"])
    return F.aggregate(labelled, start, lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def with_parcels(listings: DataFrame, parcels: DataFrame) -> DataFrame:
    """Listings with what their parcel tells, and whether its owner is an entity."""
    keys = ["parcel_number", "market"]
    spine = parcels.select(*keys, "owner_name", "property_class", "current_tax_balance", F.lit(True).alias("on_spine"))
    return listings.join(spine, keys, "left").withColumn("owner_is_entity", is_entity(F.col("owner_name")))


def enrich(listings: DataFrame, parcels: DataFrame, signals: DataFrame) -> DataFrame:
    """Listings with their parcel's owner and tax data, stacked signals, chips and the hot flag. Joined within the market."""
    keys = ["parcel_number", "market"]
    out = with_parcels(listings, parcels).join(stack_signals(signals), keys, "left")
    out = out.withColumn("chips", chips(F.col("signal_type"), F.col("type_counts")))
    return out.withColumns(
        {
            "registry_confirmed": F.coalesce("on_spine", F.lit(False)), "signal_count": F.coalesce("signal_count", F.lit(0).cast("long")),
            "owner_name": F.coalesce("owner_name", F.lit("(Owner not found)")), "dimensions": F.size("chips"), "hot": F.size("chips") >= 2,
        }
    )


@dataclasses.dataclass(frozen=True)
class ListingQuery:
    """Arguments of the listings page; None means no condition."""

    distress_stage: str = "buy_now"
    source_site: str | None = None
    status: str | None = None
    market: str | None = None
    city: str | None = None
    text: str | None = None
    county: str | None = None
    redemption_status: str | None = None
    conviction_tier: str | None = None
    min_tickets: int | None = None
    absentee: bool | None = None
    has_signals: bool | None = None
    min_signals: int | None = None
    signal_type: str | None = None
    min_balance: float | None = None
    owner_type: str | None = None
    include_duplicates: bool = False
    include_unverified: bool = False
    sort: str = "first_seen"
    descending: bool = True
    page: int = 1
    page_size: int = 50


def conditions(q: ListingQuery) -> list[Column]:
    c, out = F.col, []
    if q.distress_stage != "all":
        out.append(c("distress_stage") == q.distress_stage)
    equal = (("source_site", q.source_site), ("status", q.status), ("market", q.market), ("redemption_status", q.redemption_status), ("conviction_tier", q.conviction_tier))
    out += [c(k) == v for k, v in equal if v is not None]
    if q.county is not None:
        out.append(c("property_county").ilike(q.county))
    if q.min_tickets is not None:
        out.append(c("blight_ticket_count") >= q.min_tickets)
    if q.absentee:
        out.append(c("absentee_owner").eqNullSafe(True))
    if q.city is not None:
        out.append(c("property_city").ilike(q.city))
    if q.text is not None:
        out.append(c("property_address").ilike(f"%{q.text}%"))
    if q.has_signals is not None:
        out.append((c("signal_count") > 0) == q.has_signals)
    if q.min_signals is not None:
        out.append(c("signal_count") >= q.min_signals)
    if q.signal_type is not None:
        out.append(F.exists(F.coalesce(c("type_counts"), F.array().cast("array<struct<type:string,n:bigint>>")), lambda x: x["type"] == q.signal_type))
    if q.min_balance is not None:
        out.append(c("current_tax_balance") >= q.min_balance)
    if q.owner_type is not None:
        entity = F.coalesce(c("owner_is_entity"), F.lit(False))
        out.append(entity if q.owner_type == "entity" else ~entity)
    closed = reduce(lambda a, b: a | b, [c("case_status").ilike(f"%{w}%") for w in CLOSED_WORDS])
    out.append(~((F.coalesce(c("signal_type"), F.lit("")) == "probate") & F.coalesce(closed, F.lit(False))))
    if not q.include_duplicates:
        out.append(c("duplicate_of").isNull())
    if not q.include_unverified:
        out.append(~c("signal_type").eqNullSafe("probate") | F.coalesce(c("match_confidence").isin(VISIBLE_CONFIDENCE), F.lit(False)))
    return out


def select_listings(enriched: DataFrame, q: ListingQuery) -> DataFrame:
    df = enriched if "duplicate_of" in enriched.columns else enriched.withColumn("duplicate_of", F.lit(None).cast("string"))
    return df.filter(reduce(lambda a, b: a & b, conditions(q)))


def page(enriched: DataFrame, q: ListingQuery) -> DataFrame:
    """One page in a total order: the sort key, nulls last, then the id. Planned as a top-k, not a full sort."""
    key = F.col(SORT_KEYS.get(q.sort, "first_seen"))
    order = key.desc_nulls_last() if q.descending else key.asc_nulls_last()
    return select_listings(enriched, q).orderBy(order, "id").offset((q.page - 1) * q.page_size).limit(q.page_size)


def listings_page(listings: DataFrame, parcels: DataFrame, signals: DataFrame, q: ListingQuery) -> DataFrame:
    """:func:`page`, enriched as late as can be: unless the arguments ask for signals, the page is cut first, and only its rows' signals are read and stacked."""
    if q.has_signals is not None or q.min_signals is not None or q.signal_type is not None:
        return page(enrich(listings, parcels, signals), q)
    rows = listings if q.owner_type is None and q.min_balance is None else with_parcels(listings, parcels)
    cut = page(rows, q).select(*listings.columns)
    keys = ["parcel_number", "market"]
    # a page has at most page_size rows, so its keys are broadcast
    few = F.broadcast(cut.select(*keys).distinct())
    out = enrich(cut, parcels.join(few, keys, "left_semi"), signals.join(few, keys, "left_semi"))
    key = F.col(SORT_KEYS.get(q.sort, "first_seen"))
    return out.orderBy(key.desc_nulls_last() if q.descending else key.asc_nulls_last(), "id")


def page_counts(enriched: DataFrame, q: ListingQuery) -> DataFrame:
    total = select_listings(enriched, q).agg(F.count("*").alias("total"))
    return total.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / q.page_size)).cast("long").alias("pages"))


def listing_counts(listings: DataFrame, parcels: DataFrame, signals: DataFrame, q: ListingQuery) -> DataFrame:
    """:func:`page_counts` without what the arguments do not ask for: parcels are joined only for an owner's kind or a balance, and signals only counted, by type if a type is asked for."""
    keys = ["parcel_number", "market"]
    rows = listings if q.owner_type is None and q.min_balance is None else with_parcels(listings, parcels)
    if q.has_signals is not None or q.min_signals is not None or q.signal_type is not None:
        found = F.count_if(F.col("signal_type") == q.signal_type) if q.signal_type is not None else F.lit(0)
        counts = signals.groupBy(*keys).agg(F.count("*").alias("signal_count"), found.alias("_of_type"))
        rows = rows.join(counts, keys, "left").withColumn("signal_count", F.coalesce("signal_count", F.lit(0).cast("long")))
    if q.signal_type is not None:
        rows = rows.filter("_of_type > 0")
    return page_counts(rows, dataclasses.replace(q, signal_type=None))


def latest_per_key(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key, the smallest ``tie`` of equal ones; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    age = F.coalesce(-F.unix_micros(F.col(when).cast("timestamp")), F.lit(2**63 - 1))  # rows without a time are the oldest
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(age, F.col(tie))).alias("row"))
    return best.select(*keys, "row.*")


def source_cards(runs: DataFrame, now: Column, hours: int = 4) -> DataFrame:
    """Latest run of each source: minutes since, and whether it counts as online."""
    rest = [F.desc(c) for c in runs.columns if c not in ("source_site", "started_at")]  # of runs that began together always the same one
    newest = W.partitionBy("source_site").orderBy(F.desc("started_at"), *rest)
    last = runs.withColumn("rank", F.row_number().over(newest)).filter("rank = 1").drop("rank")
    seconds = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    return last.withColumn("minutes_since", F.floor(seconds / 60).cast("long")).withColumn("online", (F.col("status") == "success") & (seconds <= hours * 3600))
