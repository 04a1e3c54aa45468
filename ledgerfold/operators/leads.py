"""Signals to leads: which appear, which are refreshed, which retire; and tiers of blight leads."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class LeadRule:
    """How signals of one type become leads in a market (None: in all)."""

    signal_type: str
    market: str | None = None
    fresh_days: int = 4
    min_balance: float | None = None
    sold_guard_months: int = 12
    enabled: bool = True


def fresh_signals(signals: DataFrame, rule: LeadRule, now: Column) -> DataFrame:
    """Signals of the rule seen recently that pass its gate."""
    keep = (F.col("signal_type") == rule.signal_type) & (F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(rule.fresh_days)))
    if rule.market is not None:
        keep &= F.col("market") == rule.market
    if rule.min_balance is not None:
        keep &= F.col("balance") >= rule.min_balance
    return signals.filter(keep)


def retiring(leads: DataFrame, signals: DataFrame, buy_now: DataFrame, rule: LeadRule, now: Column) -> DataFrame:
    """Active leads that no fresh signal supports, or whose parcel is for sale (two existence joins, no product). Of a type that is switched off, all."""
    keys = ["parcel_number", "market"]
    if not rule.enabled:
        return leads.filter((F.col("status") == "active") & (F.col("signal_type") == rule.signal_type))
    fresh = fresh_signals(signals, rule, now).select(*keys).distinct().withColumn("supported", F.lit(True))
    sale = buy_now.filter("status = 'active'").select(*keys).distinct().withColumn("for_sale", F.lit(True))
    active = leads.filter((F.col("status") == "active") & (F.col("signal_type") == rule.signal_type))
    return active.join(fresh, keys, "left").join(sale, keys, "left").filter("supported is null or for_sale").select(*leads.columns)


def inserting(leads: DataFrame, signals: DataFrame, buy_now: DataFrame, parcels: DataFrame, latest_sales: DataFrame, rule: LeadRule, now: Column) -> DataFrame:
    """New leads: the latest fresh signal of each parcel without a lead of any status, not for sale and not sold lately."""
    keys = ["parcel_number", "market"]
    newest = fresh_signals(signals, rule, now).groupBy(*keys).agg(F.max(F.struct("observed_at", "id", "balance", "source")).alias("s"))
    open_ = newest.join(leads.filter(F.col("signal_type") == rule.signal_type).select(*keys), keys, "left_anti").join(buy_now.filter("status = 'active'").select(*keys), keys, "left_anti")
    out = open_.join(parcels.select(*keys, "situs_address", "owner_name"), keys, "left").join(latest_sales.select("parcel_number", "last_sale_date"), "parcel_number", "left")
    guard = F.col("last_sale_date").isNull() | (F.col("last_sale_date") < F.add_months(F.to_date(now), -rule.sold_guard_months))
    return out.filter(guard).select(*keys, F.lit(rule.signal_type).alias("signal_type"), "situs_address", "owner_name", F.col("s.id").alias("signal_id"), F.col("s.balance").alias("balance"), F.to_date("s.observed_at").alias("observed"))


def refreshing(leads: DataFrame, signals: DataFrame, rule: LeadRule, now: Column) -> DataFrame:
    """Active leads with fresh signals, and when these were last seen."""
    keys = ["parcel_number", "market"]
    seen = fresh_signals(signals, rule, now).groupBy(*keys).agg(F.max("last_seen_at").alias("seen"))
    return leads.filter((F.col("status") == "active") & (F.col("signal_type") == rule.signal_type)).join(seen, keys).select("id", F.to_date("seen").alias("seen"))


@dataclasses.dataclass(frozen=True)
class LeadSource:
    """Where a market's leads of one type have their address and owner from: the parcel (``spine``) or a key of the signal's payload."""

    address_source: str
    state: str
    address_key: str = "property_location"
    owner_key: str | None = None


def lead_fragments(source: LeadSource, payload: Column, situs: Column, owner: Column) -> dict[str, Column]:
    """Address, city, zip and owner of a lead. The city stands before the state, the zip ends the address; both are looked for in the parcel's address or in the payload's, as the source says."""
    told = F.get_json_object(payload, f"$.{source.address_key}")
    if source.address_source == "spine":
        place, address, named = situs, F.coalesce(F.nullif(situs, F.lit("")), told), owner
        named = F.coalesce(owner, F.get_json_object(payload, f"$.{source.owner_key}")) if source.owner_key else owner
    elif source.address_source == "payload":
        place = address = told
        named = F.get_json_object(payload, f"$.{source.owner_key}") if source.owner_key else F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown address source {source.address_source!r}")
    part = lambda pattern: F.when(place.rlike(pattern), F.regexp_extract(place, pattern, 1))
    return {"address": address, "city": F.initcap(part(rf",\s*([A-Za-z .]+?),\s*{source.state}")), "zip": part(r"([0-9]{5})(?:-[0-9]{4})?\s*$"), "owner": named}


def blight_tiers(signals: DataFrame, now: Column, fresh_days: int = 4) -> DataFrame:
    """Per parcel: tickets, their balance, and the tier: A from two tickets and 2000, B from two and 500, else C."""
    fresh = signals.filter((F.col("signal_type") == "blight_violation") & (F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(fresh_days))))
    sums = fresh.groupBy("parcel_number", "market").agg(F.count("*").alias("tickets"), F.sum("balance").alias("balance"), F.bool_or(F.col("balance") >= 2000).alias("large"))
    two = F.col("tickets") >= 2
    return sums.withColumn("tier", F.when(two & (F.col("balance") >= 2000), "A").when(two & (F.col("balance") >= 500), "B").otherwise("C"))
