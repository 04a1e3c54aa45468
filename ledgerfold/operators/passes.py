"""Passes that link, gate, pick and audit: each is a few joins and aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions.attributes import demoted, surname_absent
from ledgerfold.functions.keys import plain_key
from ledgerfold.functions.values import match_class
from ledgerfold.operators.lifecycle import FORECLOSURES, WINDOW_DAYS, _protected
from ledgerfold.operators.resolving import resolve_unique

# ---- the listing upsert

#: Columns of a listing that an update overwrites even with null, and those that it never touches.
OVERWRITE = ("status", "market")
NEVER = ("case_number", "sale_time", "sale_location", "trustee_name", "property_state")


def upsert_listings(current: DataFrame, batch: DataFrame, seq: str, *, parcel: str = "parcel_number", seen: str = "last_seen") -> DataFrame:
    """``current`` with a batch merged in, by a cascade of keys; ``is_new`` marks inserted rows.

    A batch row is looked up by (site, case, parcel) if it has both, by (site, case) if it has no parcel, by (site, parcel) if it has no case, and then by (site,
    address, sale date) if nothing was found, which is how a row that came without a parcel first gets it; else by (site, address, sale date). Sale dates match as values, null included.
    Of several rows that match, the smallest id is taken. Rows of the batch that go to the same id are collapsed in order of ``seq``, then merged: new values win where they are not null,
    ``OVERWRITE`` columns always, ``NEVER`` columns never. Rows that match nothing are inserted, one for each key; null addresses equal nothing.

    All rows of a batch are looked up in the snapshot before it. Every lookup is an equality join with one row a key, so nothing fans out.
    """
    keyed = batch.withColumn("_case", F.nullif("case_number", F.lit(""))).withColumn("_parcel", F.nullif(parcel, F.lit("")))
    has_case, has_parcel = F.col("_case").isNotNull(), F.col("_parcel").isNotNull()
    lookups = {"a": ["source_site", "case_number", parcel], "b": ["source_site", "case_number"], "c": ["source_site", parcel], "d": ["source_site", "property_address", "_day"]}
    day = F.coalesce(F.col("sale_date").cast("string"), F.lit("none"))
    rows, found = keyed.withColumn("_day", day), current.withColumn("_day", day)
    for name, keys in lookups.items():
        one = found.groupBy(*keys).agg(F.min("id").alias(f"_{name}"))
        rows = rows.join(one, keys, "left")
    rows = rows.withColumn("_id", F.when(has_case & has_parcel, F.col("_a")).when(has_case, F.col("_b")).when(has_parcel, F.coalesce("_c", "_d")).otherwise(F.col("_d")))
    own = F.when(has_case & has_parcel, F.concat_ws("|", F.lit("case and parcel"), "source_site", "_case", "_parcel")).when(has_case, F.concat_ws("|", F.lit("case"), "source_site", "_case"))
    own = own.when(has_parcel, F.concat_ws("|", F.lit("parcel"), "source_site", "_parcel")).when(F.col("property_address").isNotNull(), F.concat_ws("|", F.lit("address"), "source_site", "property_address", "_day"))
    rows = rows.withColumn("id", F.coalesce("_id", own, F.concat_ws("|", F.lit("row"), "source_site", F.col(seq).cast("string"))))
    values = [c for c in current.columns if c != "id"]
    known = [c for c in values if c in batch.columns]
    last = {c: F.max_by(c, seq) if c in OVERWRITE else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))) for c in known}
    new = rows.groupBy("id").agg(*[x.alias(c) for c, x in last.items()], F.lit(True).alias("_new"))
    joined = current.withColumn("_old", F.lit(True)).alias("a").join(new.alias("b"), "id", "full_outer")
    both = F.col("_old") & F.col("_new")

    def value(c: str) -> Column:
        if c not in known:
            return F.col(f"a.{c}")
        if c in NEVER:
            return F.when(F.col("_old"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        if c in OVERWRITE:
            return F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        if c == seen:
            return F.when(both, F.greatest(f"a.{c}", f"b.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}"))
        return F.coalesce(f"b.{c}", f"a.{c}")

    return joined.select("id", *[value(c).alias(c) for c in values], F.col("_old").isNull().alias("is_new"))


# ---- gates of leads: a Column each, over the JSON payload


def payload(key: str) -> Column:
    return F.get_json_object("payload", f"$.{key}")


def payload_number(key: str) -> Column:
    """Digits and points only; '1.2.3' is no number, so null."""
    text = payload(key)
    return F.when(text.rlike(r"^[0-9.]+$"), text.try_cast("decimal(18,2)"))


def balance_gate(key: str, least: float, *, or_true: str | None = None, with_prefix: tuple[str, str] | None = None) -> Column:
    """A balance of at least so much; or a flag that is true; or only for classes with a prefix."""
    out = payload_number(key) >= least
    if or_true is not None:
        out = F.coalesce(out, F.lit(False)) | F.coalesce(payload(or_true) == "true", F.lit(False))
    if with_prefix is not None:
        out = out & payload(with_prefix[0]).startswith(with_prefix[1])
    return F.coalesce(out, F.lit(False))


def open_since_gate(status: str, opened: str, now: Column, months: int = 24) -> Column:
    day = F.when(payload(opened).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.left(payload(opened), F.lit(10)), "yyyy-MM-dd"))
    return F.coalesce(payload(status).ilike("open") & (day >= F.add_months(F.to_date(now), -months)), F.lit(False))


def open_or_graded_gate(status: str, grade: str, least: int = 3) -> Column:
    graded = F.when(payload(grade).rlike("^[0-9]+$"), payload(grade).try_cast("int") >= least)
    return F.coalesce(payload(status).ilike("open"), F.lit(False)) | F.coalesce(payload(status).ilike("active"), F.lit(False)) | F.coalesce(graded, F.lit(False))


def in_collections_gate() -> Column:
    return F.coalesce(payload("disposition").ilike("responsible%") & (payload("collection_status") == "In Collections") & (payload_number("amt_balance_due") > 0), F.lit(False))


def residential(signals: DataFrame, parcels: DataFrame) -> DataFrame:
    """Signals of residential parcels: an existence join, before the gate."""
    return signals.join(parcels.filter(F.col("property_class").ilike("residential%")).select("parcel_number", "market"), ["parcel_number", "market"], "left_semi")


# ---- links


def resolve_by_address(listings: DataFrame, parcels: DataFrame, market: str, types: list[str] = FORECLOSURES) -> DataFrame:
    """Active foreclosures of the market without a parcel get the one whose address is theirs; none where several have it."""
    spine = parcels.filter((F.col("market") == market) & (F.col("situs_address") != ""))
    poor = (F.col("market") == market) & (F.col("status") == "active") & (F.coalesce("parcel_number", F.lit("")) == "") & F.col("signal_type").isin(types)
    out = resolve_unique(listings, F.when(poor, plain_key(F.col("property_address"))), spine, plain_key(F.col("situs_address")), out="_found")
    return out.withColumn("parcel_number", F.coalesce("_found", "parcel_number")).drop("_found")


def two_paths(cases: DataFrame, by_name: DataFrame, by_address: DataFrame, cap: int = 5) -> DataFrame:
    """Parcels of probate cases from two sets of hits: (case_number, parcel_number, method, confidence).

    ``cases``: case_number, decedent_name. Hits: case_number, parcel_number, owner_name, and score for names. A case with more than ``cap`` address hits keeps those that its name hits
    too; one with more than ``cap`` name hits keeps those with an address. A name alone must be probable. Where the owner has another surname than the decedent, a match that rests on the address goes to review.
    """
    names = by_name.groupBy("case_number", "parcel_number").agg(F.max("score").alias("score"), F.min("owner_name").alias("name_owner"))
    places = by_address.groupBy("case_number", "parcel_number").agg(F.min("owner_name").alias("place_owner"), F.lit(True).alias("placed"))
    many_places = places.groupBy("case_number").agg((F.count("*") > cap).alias("many_places"))
    many_names = names.groupBy("case_number").agg((F.count("*") > cap).alias("many_names"))
    both = names.join(places, ["case_number", "parcel_number"], "full_outer").join(many_places, "case_number", "left").join(many_names, "case_number", "left")
    named, placed = F.col("score").isNotNull(), F.coalesce("placed", F.lit(False))
    placed = placed & (named | ~F.coalesce("many_places", F.lit(False)))
    both = both.withColumn("method", F.when(placed & named, "composite").when(placed, "address_anchor").when(named, "name_match")).filter("method is not null")
    both = both.withColumn("tier", match_class(F.col("method"), F.col("score")))
    alone = F.col("method") == "name_match"
    kept = both.filter(~alone | (~F.coalesce("many_names", F.lit(False)) & (F.col("tier") != "unverified"))).join(cases.select("case_number", "decedent_name"), "case_number")
    mismatch = surname_absent(F.col("decedent_name"), F.coalesce("name_owner", "place_owner"))
    return kept.select("case_number", "parcel_number", "method", demoted(F.col("tier"), F.col("method"), mismatch).alias("confidence"))


def join_last(rows: DataFrame, other: DataFrame, key: Column, other_key: Column, value: str, order: str) -> DataFrame:
    """Adds ``value`` of the other table by key; of equal keys the last in ``order`` counts."""
    one = other.select(other_key.alias("_key"), F.col(value), F.col(order)).filter("_key is not null").groupBy("_key").agg(F.max_by(value, order).alias(value))
    return rows.withColumn("_key", key).join(one, "_key", "left").drop("_key")


def live_parcels(rows: DataFrame, registry: DataFrame, answered: DataFrame, key: str = "parcel_number", chunk: str = "chunk") -> DataFrame:
    """Rows whose parcel the registry still has; chunks that the registry did not answer (absent from ``answered``) pass whole."""
    known, asked = registry.select(key).distinct().withColumn("_known", F.lit(True)), answered.select(chunk).distinct().withColumn("_asked", F.lit(True))
    return rows.join(known, key, "left").join(asked, chunk, "left").filter("_known or _asked is null").drop("_known", "_asked")


def per_address(filings: DataFrame, key: Column, filed: str, landlord: str) -> DataFrame:
    """Per address: filings, the latest day, and the landlord of that day (the first by name of several), else any."""
    keyed = filings.withColumn("key", key)
    named = F.nullif(F.btrim(landlord), F.lit(""))
    # later days first, rows without a day last; of one day the first name
    order = F.struct(F.coalesce(-F.unix_date(filed), F.lit(2**31 - 1)), named)
    # the key is dear: a filter on it would be moved below the grouping and compute it again, so what is filtered is an aggregate
    sums = keyed.groupBy("key").agg(F.count("*").alias("filings"), F.max(filed).alias("latest"), F.min_by(named, F.when(named.isNotNull(), order)).alias("landlord"), F.count("key").alias("_keyed"))
    return sums.filter("_keyed > 0").drop("_keyed")


def case_sizes(listings: DataFrame) -> DataFrame:
    """Adds how many rows share the case number. Cases are counted and joined back, rows without one by their number alone, so none of them has to be in one task."""
    known, without = listings.filter("case_number is not null"), listings.filter("case_number is null")
    counts = known.groupBy("case_number").agg(F.count("*").alias("case_rows"))
    return known.join(counts, "case_number").select(*listings.columns, "case_rows").unionByName(without.withColumn("case_rows", F.lit(without.count()).cast("bigint")))


def sale_targets(parcels: DataFrame, signals: DataFrame, known: DataFrame, market: str, most: int, types: tuple[str, ...] = ("tax_delinquent", "code_violation")) -> DataFrame:
    """The next ``most`` parcels of the market without a known sale: those with a distress signal first, then by number."""
    marked = signals.filter((F.col("market") == market) & F.col("signal_type").isin(*types)).select("parcel_number").distinct().withColumn("signalled", F.lit(True))
    rows = parcels.filter(F.col("market") == market).join(known.select("parcel_number"), "parcel_number", "left_anti").join(marked, "parcel_number", "left")
    return rows.select("parcel_number", F.coalesce("signalled", F.lit(False)).alias("signalled")).orderBy(F.desc("signalled"), "parcel_number").limit(most)


# ---- policies


def with_policy(rows: DataFrame, policies: dict[str, str], default: str = "full_rescan", site: str = "source_site") -> DataFrame:
    """Adds the source's staleness policy; sources without one are rescanned in full."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in policies.items() for x in kv]), F.col(site))
    return rows.withColumn("policy", F.coalesce(known, F.lit(default)))


def may_mark_stale(runs: DataFrame, policies: dict[str, str]) -> DataFrame:
    """Sources whose last run lets absence count: full scans that found something without errors."""
    return with_policy(runs, policies).filter("policy = 'full_rescan' and found > 0 and errors = 0").select("source_site")


# ---- audits


def stale_active(listings: DataFrame, now: Column, as_of: Column, policies: dict[str, str], hours: int = 7) -> DataFrame:
    """Active rows of rescanned sources that no scan has seen for hours, unless time does not retire them."""
    late = (F.col("status") == "active") & (F.col("last_seen") < now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("policy") == "full_rescan")
    return with_policy(listings, policies).filter(late & ~_protected(as_of)).select("id", "source_site", "last_seen")


def redemption_conformance(listings: DataFrame, as_of: Column) -> DataFrame:
    """Active Wayne mortgages past their window, and those within it that carry no stamp: (id, problem)."""
    wayne = listings.filter("market = 'wayne' and signal_type = 'mortgage_foreclosure' and status = 'active'")
    over = wayne.filter(F.col("sale_date") < F.date_sub(as_of, WINDOW_DAYS)).select("id", F.lit("past_180d_not_expired").alias("problem"))
    bare = wayne.filter((F.col("sale_date") < as_of) & (F.col("redemption_ends").isNull() | F.col("redemption_status").isNull())).select("id", F.lit("in_redemption_unstamped").alias("problem"))
    return over.unionByName(bare)


def orphan_leads(leads: DataFrame, lead_types: DataFrame, signals: DataFrame, now: Column, days: int = 4) -> DataFrame:
    """Active leads without a fresh signal of their source's type: (id, source_site)."""
    typed = leads.filter("distress_stage = 'distress_signal' and status = 'active'").select("id", "source_site", "parcel_number").join(lead_types.select("source_site", "signal_source", F.col("signal_type").alias("type")), "source_site")
    fresh = signals.filter(F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(days))).select("parcel_number", F.col("source").alias("signal_source"), F.col("signal_type").alias("type")).distinct()
    return typed.join(fresh, ["parcel_number", "signal_source", "type"], "left_anti").select("id", "source_site")


def shown_without_decedent(listings: DataFrame) -> DataFrame:
    shown = "signal_type = 'probate' and status = 'active' and match_confidence in ('confirmed', 'probable') and decedent_name is null"
    return listings.groupBy("market").agg(F.count_if(F.expr(shown)).alias("shown"))


def same_source_duplicates(listings: DataFrame, by: str) -> DataFrame:
    """Active rows of one source that share a parcel or an address: (source_site, key, n)."""
    live = listings.filter((F.col("status") == "active") & (F.col(by) != ""))
    return live.groupBy("source_site", F.col(by).alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


# ---- cards


def source_sections(cards: DataFrame) -> DataFrame:
    """Per section (deals, signals; leads are in neither): sources and how many are online."""
    section = F.when(F.col("category") == "deal", "deals").when(F.col("category").isin("signal", "registry"), "signals")
    return cards.withColumn("section", section).filter("section is not null").groupBy("section").agg(F.count("*").alias("sources"), F.count_if("online").alias("online"))


def source_choices(cards: DataFrame, category: str, market: str) -> DataFrame:
    """Sources of a category whose name has the market's, by name."""
    return cards.filter((F.col("category") == category) & F.contains(F.lower("source_site"), F.lit(market.lower()))).select("source_site").orderBy("source_site")
