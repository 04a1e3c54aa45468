"""Audits: collapses of sources, data quality, orphans, conformance, and a health snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions.addresses import has_street_number


def collapses(runs: DataFrame, share: float = 0.4, least: int = 50) -> DataFrame:
    """Sources whose latest run found much less than the one before; of runs that began together the one that found more is the later."""
    newest = W.partitionBy("source_site").orderBy(F.desc("started_at"), F.desc("found"))
    last = runs.filter("status = 'success'").withColumn("rank", F.row_number().over(newest)).withColumn("before", F.lead("found").over(newest)).filter("rank = 1 and before is not null")
    drop = F.col("before") - F.col("found")
    return last.filter((F.col("before") >= least) & (drop > share * F.col("before"))).select("source_site", "before", "found", F.round(drop / F.col("before"), 4).alias("drop_share"))


def zero_yields(runs: DataFrame, now: Column, days: int = 75, least: float = 30.0, least_runs: int = 2) -> DataFrame:
    """Sources whose latest run found nothing although their median of late says otherwise."""
    recent = runs.filter(F.col("started_at") >= now - F.make_dt_interval(F.lit(days)))
    usual = recent.filter("status = 'success' and found > 0").groupBy("source_site").agg(F.percentile("found", F.lit(0.5)).alias("median"), F.count("*").alias("runs"))
    latest = recent.groupBy("source_site").agg(F.max_by("found", "started_at").alias("found"))
    return latest.filter("found = 0").join(usual, "source_site").filter((F.col("median") >= least) & (F.col("runs") >= least_runs)).select("source_site", "median", "runs")


def trailing_zero_runs(runs: DataFrame) -> DataFrame:
    """Per source: how many of its latest runs in a row found nothing."""
    newest = W.partitionBy("source_site").orderBy(F.desc("started_at")).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = runs.withColumn("hits", F.sum((F.col("found") > 0).cast("int")).over(newest))
    return seen.groupBy("source_site").agg(F.count_if(F.col("hits") == 0).alias("zero_runs"))


def stale_active(listings: DataFrame, as_of: Column) -> DataFrame:
    """Active although the sale is over."""
    return listings.filter((F.col("status") == "active") & (F.col("sale_date") < as_of)).select("id", "market", "sale_date", F.datediff(as_of, "sale_date").cast("long").alias("days_over"))


def address_reasons(listings: DataFrame) -> DataFrame:
    """Rows with an incomplete address and why."""
    a = F.col("property_address")
    reasons = F.array_compact(F.array(F.when(a.isNull(), "no address"), F.when(~has_street_number(a), "no number"), F.when(F.col("parcel_number").isNull(), "no parcel"), F.when(F.col("property_city").isNull(), "no city")))
    return listings.select("id", F.array_join(reasons, "; ").alias("reasons")).filter("reasons <> ''")


def probate_validity(listings: DataFrame) -> DataFrame:
    """Probate rows by confidence tier and closed state."""
    state = F.when(F.split_part(F.upper("case_status"), F.lit(" - "), F.lit(1)) == "CLOSED", "closed").when(F.col("case_status").isNull(), "unknown").otherwise("open")
    return listings.filter("signal_type = 'probate'").groupBy(F.coalesce("match_confidence", F.lit("NULL")).alias("tier"), state.alias("state")).agg(F.count("*").alias("n"))


def coverage_drift(runs: DataFrame, share: float = 0.15) -> DataFrame:
    """Latest runs whose active count is off the found count by more than ``share``."""
    last = runs.groupBy("source_site").agg(F.max_by(F.struct("found", "active"), "started_at").alias("r")).select("source_site", "r.*")
    drift = F.abs(F.col("active") - F.col("found")) / F.col("found")
    return last.filter(F.col("found") > 0).filter(drift > share).select("source_site", "found", "active", F.round(drift, 4).alias("drift"))


def orphan_signals(signals: DataFrame, parcels: DataFrame) -> DataFrame:
    """Signals of parcels that are not on the spine, by market and type."""
    return signals.join(parcels.select("parcel_number", "market"), ["parcel_number", "market"], "left_anti").groupBy("market", "signal_type").agg(F.count("*").alias("n"))


def lead_overlap(listings: DataFrame) -> DataFrame:
    """Active leads whose parcel is also for sale."""
    sale = listings.filter("distress_stage = 'buy_now' and status = 'active'").select("parcel_number", "market")
    return listings.filter("distress_stage = 'distress_signal' and status = 'active'").join(sale, ["parcel_number", "market"], "left_semi").select("id", "parcel_number", "market")


def transfer_breaches(listings: DataFrame, latest: DataFrame) -> DataFrame:
    """Active rows whose parcel was sold after they were first seen."""
    return listings.filter("status = 'active'").join(latest, "parcel_number").filter("last_sale_date > first_seen").select("id", "parcel_number", "first_seen", "last_sale_date")


def health(listings: DataFrame, signals: DataFrame, parcels: DataFrame, as_of: Column) -> DataFrame:
    """Named counts, each table read once."""
    checks = {
        "active": F.col("status") == "active", "expired": F.col("status") == "expired", "leads": F.col("distress_stage") == "distress_signal", "no_parcel": F.col("parcel_number").isNull(), "no_address": F.col("property_address").isNull(),
        "past_sale_active": (F.col("status") == "active") & (F.col("sale_date") < as_of), "no_type": F.col("signal_type").isNull(),
    }
    tables = [
        listings.agg(F.count("*").alias("listings"), *[F.count_if(c).alias(k) for k, c in checks.items()]),
        signals.agg(F.count("*").alias("signals"), F.count_if(F.col("market").isNull()).alias("signals_no_market")),
        parcels.agg(F.count("*").alias("parcels"), F.count_if(F.col("owner_name").isNull()).alias("parcels_no_owner")),
    ]
    return reduce(DataFrame.unionByName, [t.unpivot([], t.columns, "metric", "n") for t in tables])


def verdicts(listings: DataFrame, as_of: Column) -> DataFrame:
    """VALID, REVIEW or STALE for each active row, with its age in days."""
    age = F.datediff(as_of, "first_seen").cast("long")
    stale = (F.col("sale_date") < as_of) | F.coalesce(F.col("case_status").ilike("closed%"), F.lit(False))
    review = F.col("property_address").isNull() | F.col("parcel_number").isNull() | (F.coalesce(F.col("match_confidence"), F.lit("confirmed")).isin("review", "unverified"))
    return listings.filter("status = 'active'").select("id", age.alias("age_days"), F.when(F.coalesce(stale, F.lit(False)), "STALE").when(review, "REVIEW").otherwise("VALID").alias("verdict"))
