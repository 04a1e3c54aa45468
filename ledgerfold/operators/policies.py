"""Further passes and checks: prefilter, schedules, rechecks, policies, links and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions.keys import plain_key
from ledgerfold.functions.values import quoted
from ledgerfold.operators.folding import upper_middle
from ledgerfold.operators.lifecycle import FORECLOSURES

def prefilter(rows: DataFrame, states: list[str]) -> DataFrame:
    """Adds ``reason``: why a landed row is not taken; null if it is. A blank state passes."""
    state, address = F.upper(F.btrim("property_state")), F.btrim("property_address")
    return rows.withColumn("reason", F.when((state != "") & ~state.isin(states), "state").when(F.coalesce(address, F.lit("")) == "", "address"))


def schedule_lookup(rows: DataFrame, schedule: DataFrame, code: str, prefix: str) -> DataFrame:
    """Sale dates by code, which the schedule may give with or without its prefix."""
    both = schedule.select("code", "sale_date").unionByName(schedule.select(F.concat(F.lit(prefix), "code").alias("code"), "sale_date"))
    one = both.groupBy("code").agg(F.max("sale_date").alias("scheduled"))
    return rows.join(one, rows[code] == one["code"], "left").drop(one["code"])


def enrich_by_case(listings: DataFrame, target: str, donor: str) -> DataFrame:
    """Rows of one source without a parcel take it from another source's row of the same case and market; the smallest of several."""
    give = listings.filter((F.col("source_site") == donor) & F.col("parcel_number").isNotNull()).groupBy("case_number", "market").agg(F.min("parcel_number").alias("given"))
    poor = listings.filter((F.col("source_site") == target) & F.col("parcel_number").isNull() & F.col("case_number").isNotNull())
    return poor.join(give, ["case_number", "market"]).select("id", "case_number", "market", "given")


def retire_empty(listings: DataFrame, parcels: DataFrame, latest: DataFrame, market: str, types: list[str] = FORECLOSURES) -> DataFrame:
    """Active foreclosures of the market expire if their parcel has neither owner nor sale nor value."""
    facts = parcels.filter(F.col("market") == market).join(latest, "parcel_number", "left")
    facts = facts.select("parcel_number", "market", (F.col("owner_name").isNull() & F.col("last_sale_date").isNull() & F.col("current_market_value").isNull()).alias("nothing"))
    joined = listings.join(facts, ["parcel_number", "market"], "left")
    return joined.withColumn("status", F.when((F.col("status") == "active") & F.col("signal_type").isin(types) & F.col("nothing"), "expired").otherwise(F.col("status"))).drop("nothing")


def retire_outside(listings: DataFrame, inside: list[str], market: str, courthouse: str, types: list[str] = FORECLOSURES) -> DataFrame:
    """Active foreclosures of the market expire if their address is the courthouse's, or if they have no parcel and a city that lies outside."""
    city = F.lower(F.btrim("property_city"))
    outside = (F.coalesce("parcel_number", F.lit("")) == "") & (city != "") & ~city.isin(inside)
    gone = plain_key(F.col("property_address")).startswith(courthouse) | outside
    return listings.withColumn("status", F.when((F.col("market") == market) & (F.col("status") == "active") & F.col("signal_type").isin(types) & F.coalesce(gone, F.lit(False)), "expired").otherwise(F.col("status")))


def recheck(listings: DataFrame, checked: DataFrame) -> DataFrame:
    """Court rechecks: a closed case expires the row, another status is taken over. A case that was checked more than once counts once: closed, if any check says so."""
    closed_first = F.struct((~F.col("case_status").rlike("(?i)closed|dismissed|terminated")).alias("open"), "case_status")
    one = checked.filter("case_status is not null").groupBy("case_number").agg(F.min_by("case_status", closed_first).alias("found"))
    joined = listings.join(one, "case_number", "left")
    closed = F.coalesce(F.col("found").rlike("(?i)closed|dismissed|terminated"), F.lit(False))
    return joined.withColumn("status", F.when(closed, "expired").otherwise(F.col("status"))).withColumn("case_status", F.coalesce("found", "case_status")).drop("found")


def resolution_action(old: Column, new: Column) -> Column:
    """What a new match class means for a row: keep, retier, hide, retire or nothing."""
    visible = ["confirmed", "probable"]
    return F.when(new.isNull(), F.when(old.isin(visible), "retire").otherwise("noop")).when(old.eqNullSafe(new), "keep").when(new.isin(visible), "retier").when(old.isin(visible), "hide").otherwise("noop")


def verify_links(listings: DataFrame) -> DataFrame:
    """Search links from the address; one that has its city already is used as it is."""
    a = F.col("property_address")
    whole = F.when(a.contains(","), a).otherwise(F.concat_ws(", ", a, F.col("property_city"), F.col("property_state")))
    return listings.select("id", F.when(a.isNotNull(), F.concat(F.lit("https://maps.example.com/?q="), quoted(whole))).alias("link"))


def overmatched(listings: DataFrame, cap: int = 8) -> DataFrame:
    """Probate cases on more parcels than a case can have."""
    return listings.filter("signal_type = 'probate' and case_number is not null").groupBy("market", "case_number").agg(F.count_distinct("parcel_number").alias("parcels")).filter(F.col("parcels") > cap)


def stale_open(signals: DataFrame, now: Column, days: int = 45, most: int | None = 2000) -> DataFrame:
    """Open violations that nobody has confirmed for long: a report of the ``most`` oldest (None: all)."""
    old = signals.filter("signal_type = 'code_violation'").filter(F.col("last_seen_at") < now - F.make_dt_interval(F.lit(days))).select("id", "market", "last_seen_at")
    return old if most is None else old.orderBy("last_seen_at", "id").limit(most)


def long_zero_runs(runs: DataFrame, cursor: bool, share: float = 0.5) -> DataFrame:
    """Sources whose latest run fell by ``share`` against their upper median; cursor sources only after three empty runs in a row."""
    newest = W.partitionBy("source_site").orderBy(F.desc("started_at"))
    seen = runs.withColumn("rank", F.row_number().over(newest)).withColumn("hits", F.sum((F.col("found") > 0).cast("int")).over(newest.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sums = seen.groupBy("source_site").agg(F.max(F.when(F.col("rank") == 1, F.col("found"))).alias("latest"), F.count_if(F.col("hits") == 0).alias("zeros"), upper_middle("found", "rank > 1").cast(dict(runs.dtypes)["found"]).alias("usual"))
    fallen = (F.col("usual") > 0) & (F.col("latest") <= (1 - share) * F.col("usual"))
    return sums.filter(fallen & ((F.col("zeros") >= 3) | F.lit(not cursor))).select("source_site", "usual", "latest", "zeros")


def identity_proof(parcels: DataFrame, signals: DataFrame) -> DataFrame:
    """Per market: parcels, those with an owner, signals, and signals of parcels that the market lacks."""
    spine = parcels.groupBy("market").agg(F.count("*").alias("parcels"), F.count("owner_name").alias("owned"))
    known = parcels.select("parcel_number", "market", F.lit(1).alias("known"))
    hits = signals.join(known, ["parcel_number", "market"], "left").groupBy("market").agg(F.count("*").alias("signals"), F.count_if(F.col("known").isNull()).alias("orphans"))
    return spine.join(hits, "market", "left").select("market", "parcels", "owned", F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("orphans", F.lit(0)).alias("orphans"))


def infer_market(rows: DataFrame, by_parcel: DataFrame, by_state: dict[str, str]) -> DataFrame:
    """Fills a missing market from the parcel if it is in one market only, else from the state."""
    one = by_parcel.groupBy("parcel_number").agg(F.min("market").alias("lo"), F.max("market").alias("hi")).filter("lo = hi").select("parcel_number", F.col("lo").alias("inferred"))
    state = F.element_at(F.create_map(*[F.lit(x) for kv in by_state.items() for x in kv]), F.col("property_state"))
    return rows.join(one, "parcel_number", "left").withColumn("market", F.coalesce("market", "inferred", state)).drop("inferred")


def require_empty(breaches: DataFrame, what: str) -> None:
    """A guard before a migration: fails if there is any breach, and reads no more than one."""
    if not breaches.isEmpty():
        raise ValueError(f"{what}: {breaches.limit(3).collect()}")


def run_record(source: str, rows: DataFrame, new: str = "is_new", reason: str = "reason") -> DataFrame:
    """The counters of a run in one pass; a run with errors (rows whose reason is ``error``) that inserted nothing is one."""
    out = rows.agg(F.count("*").alias("found"), F.count_if(F.col(reason).isNull()).alias("passed"), F.count_if(F.col(reason).isNotNull()).alias("filtered"), F.count_if(F.col(new) & F.col(reason).isNull()).alias("inserted"), F.count_if(F.col(reason) == "error").alias("errors"))
    return out.select(F.lit(source).alias("source_site"), "*", F.when((F.col("errors") > 0) & (F.col("inserted") == 0), "error").otherwise("success").alias("status"))


def retire_absent(state: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the state that a full snapshot lacks."""
    return state.join(snapshot.select(*keys), keys, "left_anti")
