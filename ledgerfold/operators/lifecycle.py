"""Lifecycle passes over listings: each maps a snapshot to the next. Three-valued logic is kept by staying in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions.addresses import has_street_number, match_address
from ledgerfold.functions.values import case_digits

WINDOW_DAYS = 180


def _protected(as_of: Column) -> Column:
    """Rows that time does not retire: tax deeds in redemption or sold, Wayne mortgages within their window. Null where unknown."""
    deed = (F.col("signal_type") == "tax_deed") & ((F.col("redemption_status") == "pending") | (F.col("sale_date") < as_of))
    wayne = (F.col("market") == "wayne") & (F.col("signal_type") == "mortgage_foreclosure") & (F.datediff(as_of, "sale_date") <= WINDOW_DAYS)
    return deed | wayne


def mark_stale(listings: DataFrame, run_start: Column, as_of: Column) -> DataFrame:
    """Not seen in the last full scan: not_listed. Only where it is certain that nothing protects the row."""
    gone = ~F.col("status").isin("not_listed", "cancelled", "sold", "expired") & (F.col("last_seen") < run_start) & ~_protected(as_of)
    return listings.withColumn("status", F.when(gone, "not_listed").otherwise(F.col("status")))


def mark_expired(listings: DataFrame, as_of: Column) -> DataFrame:
    deed = (F.col("signal_type") == "tax_deed") & (F.col("redemption_status").isNull() | (F.col("redemption_status") == "pending"))
    wayne = (F.col("market") == "wayne") & (F.col("signal_type") == "mortgage_foreclosure") & (F.datediff(as_of, "sale_date") <= WINDOW_DAYS)
    over = (F.col("sale_date") < as_of) & F.col("status").isin("active", "not_listed") & ~F.coalesce(deed | wayne, F.lit(False))
    return listings.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def flag_addresses(listings: DataFrame) -> DataFrame:
    return listings.withColumn("address_status", F.when(~has_street_number(F.col("property_address")), "no_street_number"))


# Probate case numbers that begin with the filing year, markets whose foreclosure numbers do, and foreclosure types.
YEAR_CASES = [r"^[0-9]{4}EST", r"^[0-9]{4} ES"]
YEAR_FORECLOSURES = {"dayton": r"^[0-9]{4}"}
FORECLOSURES = ["mortgage_foreclosure", "foreclosure_filing", "tax_delinquent_foreclosure"]


def mark_transferred(listings: DataFrame, latest_sales: DataFrame, year_cases: list[str] = YEAR_CASES, year_foreclosures: dict[str, str] = YEAR_FORECLOSURES) -> DataFrame:
    """Active rows whose parcel was sold out from under them: after it was first seen, or, in probate, from the case's year or the filing date on, or,
    in markets whose foreclosure numbers begin with the year, from that year on."""
    joined = listings.join(latest_sales.select("parcel_number", "last_sale_date"), "parcel_number", "left")
    case, sold = F.col("case_number"), F.col("last_sale_date")
    year = F.make_date(F.substring(case, 1, 4).try_cast("int"), F.lit(1), F.lit(1))
    of_year = lambda pattern: case.rlike(pattern) & (sold >= F.when(case.rlike(pattern), year))
    rules = [sold > F.col("first_seen").cast("date")]
    rules += [(F.col("signal_type") == "probate") & of_year(pattern) for pattern in year_cases]
    if "filing_date" in listings.columns:
        rules.append((F.col("signal_type") == "probate") & (sold >= F.col("filing_date")))
    rules += [(F.col("market") == market) & F.col("signal_type").isin(FORECLOSURES) & of_year(pattern) for market, pattern in year_foreclosures.items()]
    moved = (F.col("status") == "active") & reduce(lambda a, b: a | b, rules)
    return joined.withColumn("status", F.when(moved, "transferred").otherwise(F.col("status"))).drop("last_sale_date")


def redemption_windows(listings: DataFrame, parcels: DataFrame) -> DataFrame:
    """Tennessee tax deeds with a confirmation order: days to redeem by years of delinquency, counted from the order; pending from then on.

    Rows that were redeemed or are final stay out.
    """
    spine = parcels.select("parcel_number", "market", "tax_years_delinquent")
    open_ = "signal_type = 'tax_deed' and market = 'shelby' and confirmation_order_date is not null and (redemption_status is null or redemption_status = 'pending')"
    deeds = listings.filter(open_).join(spine, ["parcel_number", "market"], "left").withColumn("redemption_status", F.lit("pending"))
    years = F.col("tax_years_delinquent")
    out = deeds.withColumn("redemption_window_days", F.when(years >= 8, 90).when(years >= 5, 180).otherwise(365)).withColumn(
        "redemption_basis", F.when(years >= 8, "8yr_plus").when(years >= 5, "5_to_7yr").when(years.isNotNull(), "le_5yr").otherwise("default_assumed")
    )
    return out.withColumn("redemption_ends", F.date_add("confirmation_order_date", F.col("redemption_window_days")))


def michigan_redemption(listings: DataFrame, as_of: Column) -> DataFrame:
    mortgages = listings.filter("market = 'wayne' and signal_type = 'mortgage_foreclosure' and sale_date is not null")
    ends = F.date_add("sale_date", WINDOW_DAYS)
    return mortgages.withColumn("redemption_ends", ends).withColumn("redemption_status", F.when((F.col("sale_date") < as_of) & (ends >= as_of), "pending")).withColumn("redemption_basis", F.lit("mi_6mo"))


def finalize_redemptions(windows: DataFrame, as_of: Column) -> DataFrame:
    over = F.col("redemption_status").eqNullSafe("pending") & (F.col("redemption_ends") < as_of)
    return windows.withColumn("status", F.when(over, "final").otherwise(F.col("status"))).withColumn("redemption_status", F.when(over, "final").otherwise(F.col("redemption_status")))


def mark_duplicates(listings: DataFrame) -> DataFrame:
    """``duplicate_of``: the best listing of the same parcel (or address) in the market; null for the best itself.

    Best: has a sale date, then the latest, then seen first, then the smallest id. Rows without parcel and address stay apart.
    """
    keyed = listings.withColumn("_key", F.coalesce(F.nullif("parcel_number", F.lit("")), match_address(F.col("property_address"))))
    live = keyed.filter("status in ('active', 'not_listed') and _key is not null")
    order = F.struct(F.col("sale_date").isNull(), F.datediff(F.lit("1900-01-01").cast("date"), "sale_date"), F.col("first_seen"), F.col("id"))
    best = live.groupBy("market", "_key").agg(F.min_by("id", order).alias("best"))  # pre-aggregated, unlike a window over a hot key
    out = keyed.join(best, ["market", "_key"], "left")
    dup = F.col("status").isin("active", "not_listed") & (F.col("best") != F.col("id"))
    return out.withColumn("duplicate_of", F.when(dup, F.col("best"))).drop("_key", "best")


def attach_twins(listings: DataFrame) -> DataFrame:
    """Parcel-less rows that share address and case digits with exactly one row that has a parcel: (id, canonical)."""
    keyed = listings.withColumn("address_key", match_address(F.col("property_address"))).withColumn("digits", case_digits(F.col("case_number"))).filter("address_key is not null and digits <> ''")
    candidates = keyed.filter("parcel_number is not null").groupBy("market", "address_key", "digits").agg(F.count("*").alias("n"), F.min("id").alias("canonical")).filter("n = 1")
    return keyed.filter("parcel_number is null").join(candidates, ["market", "address_key", "digits"]).select("id", "canonical")


def owner_backfill(parcels: DataFrame, signals: DataFrame, market: str = "shelby") -> DataFrame:
    """Parcels of the market without an owner, with the owner that the payload of the latest tax signal names (of any market): (parcel_number, market, owner_name)."""
    owner = F.nullif(F.btrim(F.get_json_object("payload", "$.owner")), F.lit(""))
    tax = signals.filter("signal_type = 'tax_delinquent'").groupBy("parcel_number").agg(F.max_by(owner, F.struct("observed_at", "id")).alias("found")).filter("found is not null")
    blank = parcels.filter((F.col("market") == market) & (F.coalesce(F.btrim("owner_name"), F.lit("")) == ""))
    return blank.join(tax, "parcel_number").select("parcel_number", "market", F.col("found").alias("owner_name"))


def rank_newest(df: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """Rank by time, newest first; of equal times the smaller ``tie`` first."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(when), tie)))
