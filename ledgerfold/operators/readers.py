"""What a source's rows go through before they are merged: filters of single sources, two readers of one sale, folds of a tape, and the verdict on a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.names import name_confidence

# ---- filters of single sources, each a condition that is true for rows that are taken. The words and bounds of the sources.

MOST_UNITS = 5
NOTICE_DAYS = 90


def for_sale(status: Column, available: Column) -> Column:
    """A land bank's row that can be bought: both signs must say so, to the letter."""
    return status.eqNullSafe(F.lit("FOR SALE")) & available.eqNullSafe(F.lit("Y"))


def case_active(status: Column) -> Column:
    return F.coalesce(F.upper(F.btrim(status)), F.lit("")) == "ACTIVE"


def not_removed(code: Column) -> Column:
    """Rows marked RM were redeemed or withdrawn."""
    return F.coalesce(F.upper(F.btrim(code)), F.lit("")) != "RM"


def not_redeemed(redeemed: Column) -> Column:
    """0 and unknown count as not redeemed."""
    return F.coalesce(redeemed, F.lit(0)) == 0


def in_program(program: Column, allowed: list[str], denied: list[str]) -> Column:
    """A program that is sold and not restricted; the denied ones go first."""
    name = F.coalesce(F.btrim(program), F.lit(""))
    return ~name.isin(denied) & name.isin(allowed)


def in_county(state: Column, county: Column, of: tuple[str, str]) -> Column:
    """A search by radius also finds other counties."""
    clean = lambda c: F.coalesce(F.upper(F.btrim(c)), F.lit(""))
    return (clean(state) == of[0]) & (clean(county) == of[1])


def small_building(units: Column, most: int = MOST_UNITS) -> Column:
    """Fewer dwellings than a complex has; unknown numbers pass."""
    return F.coalesce(units < most, F.lit(True))


def recent_notice(published: Column, today: Column, days: int = NOTICE_DAYS) -> Column:
    """Published within the days before; undated notices pass."""
    return F.coalesce(published >= F.date_sub(today, days), F.lit(True))


def from_last_year(case_year: Column, today: Column) -> Column:
    return F.coalesce(case_year >= F.year(today) - 1, F.lit(False))


def of_counties(case_number: Column, letters: str) -> Column:
    """Feeds that several counties share put the county's letter before the number."""
    return F.coalesce(F.upper(F.substring(F.btrim(case_number), 1, 1)).isin(list(letters)), F.lit(False))


# ---- two readers of one sale


def merge_by_place(first: DataFrame, second: DataFrame, parcels: DataFrame, *, key: str, order: str, fill: list[str], any_of: list[str] = ()) -> DataFrame:
    """One row for each property that either reader has: grouped by the parcel that the address ``key`` resolves to (``parcels``: key, parcel), else by the key, else not at all.

    The first reader's rows go first, then by ``order``. A group's first row stays as it is, but for the ``fill`` columns, which take the first value that is something: null, an
    empty text and zero are nothing. Flags in ``any_of`` are true if any row's is. Adds ``parcel`` and ``group_key``.
    """
    both = first.withColumn("_rank", F.lit(1)).unionByName(second.withColumn("_rank", F.lit(2)), allowMissingColumns=True)
    known = parcels.groupBy("key").agg(F.min("parcel").alias("parcel"), F.max("parcel").alias("_other")).filter("parcel = _other").select(F.col("key").alias(key), "parcel")
    joined = both.withColumn(key, F.nullif(key, F.lit(""))).join(known, key, "left")
    raw = F.concat_ws(":", F.lit("raw"), F.col("_rank").cast("string"), F.col(order).cast("string"))
    grouped = joined.withColumn("group_key", F.coalesce(F.concat(F.lit("parcel:"), F.col("parcel")), F.concat(F.lit("addr:"), F.col(key)), raw))
    at, kinds = F.struct("_rank", order), dict(both.dtypes)

    def value(c: str) -> Column:
        if c in any_of:
            return F.coalesce(F.bool_or(c), F.lit(False))
        whole = F.min_by(c, at)
        if c not in fill:
            return whole
        nothing = {"string": "", "boolean": False}.get(kinds[c], None if kinds[c] in ("date", "timestamp", "timestamp_ntz") else 0)
        filled = F.col(c).isNotNull() if nothing is None else F.coalesce(F.col(c) != F.lit(nothing), F.lit(False))
        return F.coalesce(F.min_by(c, F.when(filled, at)), whole)

    rest = [c for c in both.columns if c != "_rank"]
    return grouped.groupBy("group_key").agg(*[value(c).alias(c) for c in rest], F.min_by("parcel", at).alias("parcel"))


# ---- a tape of years and authorities


def fold_tape(rows: DataFrame, key: str, order: str, *, year: str, unpaid: str, authority: str, keep: list[str], fallback_year: int) -> DataFrame:
    """Per key: the unpaid sum, authorities and years as sorted sets, the day of the last year, and of each ``keep`` column the first row's value (``c``) and the first known one (``first_c``).

    Years that are no number count as ``fallback_year``. Rows without a key are left out.
    """
    years = F.coalesce(F.expr(f"try_cast(`{year}` as int)"), F.lit(fallback_year))
    named = F.nullif(F.btrim(authority), F.lit(""))
    kept = [x for c in keep for x in (F.min_by(c, order).alias(c), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"first_{c}"))]
    out = rows.filter(F.col(key).isNotNull() & (F.btrim(key) != "")).groupBy(key).agg(
        *kept, F.coalesce(F.sum(unpaid), F.lit(0)).alias("unpaid"), F.sort_array(F.collect_set(named)).alias("authorities"), F.sort_array(F.collect_set(years)).alias("years"), F.max(years).alias("last_year")
    )
    return out.withColumn("observed", F.make_date("last_year", F.lit(1), F.lit(1)))


def owner_explosions(rows: DataFrame, cap: int = 5, anchors: tuple[str, ...] = ("composite", "address_anchor")) -> DataFrame:
    """Cases whose matches by name alone lead to more than ``cap`` different owners: a common name, not a person."""
    owner = F.nullif(F.upper(F.btrim("owner_name")), F.lit(""))
    by_name = rows.filter(~F.coalesce(F.col("match_method").isin(*anchors), F.lit(False)) & F.col("case_number").isNotNull())
    return by_name.groupBy("case_number").agg(F.count_distinct(owner).alias("owners")).filter(F.col("owners") > cap)


def reresolve(rows: DataFrame, *, cap: int = 5, least: float = 0.75, high: float = 0.9, anchors: tuple[str, ...] = ("composite", "address_anchor")) -> DataFrame:
    """Adds ``action`` (keep_confirmed, retier, hide, retire, noop), ``new_confidence`` and ``new_score`` for matches of estates, judged anew against the parcels' owners of now.

    Reads match_method, match_confidence, match_score, decedent_name, owner_name, case_count (parcels of the case) and explosion (see :func:`owner_explosions`). Matches by address hold; in a building of many units only where the
    owner is the decedent. Matches by name need an owner who agrees, in a case that does not lead to many people.
    """
    c = F.col
    anchored = F.coalesce(c("match_method").isin(*anchors), F.lit(False))
    known = (F.coalesce(F.btrim("decedent_name"), F.lit("")) != "") & (F.coalesce(F.btrim("owner_name"), F.lit("")) != "")
    many = F.coalesce(c("case_count"), F.lit(0)) > cap
    rows = rows.withColumn("_agree", F.when(known, name_confidence(c("decedent_name"), c("owner_name"))))
    agree, hidden = c("_agree"), c("match_confidence").eqNullSafe("unverified")
    by_address = F.when(many & ~known, "hide").when(many & (agree < least), "retire").when(c("match_confidence").eqNullSafe("confirmed"), "noop").otherwise("keep_confirmed")
    by_name = F.when(c("explosion"), "retire").when(~known, F.when(many, "retire").when(hidden, "noop").otherwise("hide")).when(agree < least, "retire").otherwise("retier")
    out = rows.withColumn("action", F.when(anchored, by_address).otherwise(by_name))
    tier = F.when(c("action") == "keep_confirmed", "confirmed").when(c("action") == "retier", F.when(agree >= high, "probable").otherwise("unverified")).when(c("action") == "hide", "unverified").when(c("action") == "noop", c("match_confidence"))
    score = F.when(c("action") == "keep_confirmed", F.greatest(F.coalesce(c("match_score").cast("double"), F.lit(0.0)), F.lit(0.95))).when(c("action") == "retier", agree)
    return out.withColumns({"new_confidence": tier, "new_score": score}).drop("_agree")


# ---- the verdict on a listing


def verdict_with_notes(rows: DataFrame, today: Column) -> DataFrame:
    """Adds ``verdict`` (VALID, REVIEW, STALE) and ``notes``, the reasons in order.

    Reads status, signal_type, sale_date, auction_status, case_status, case_number, last_sale_date, last_sale_price, owner_name, current_market_value, match_confidence and lead_age_days.
    The first reason that makes a row stale is its only note.
    """
    c = F.col
    number = lambda x: F.format_number(F.coalesce(F.floor(x), F.lit(0)), 0)
    probate = F.coalesce(c("signal_type"), F.lit("")) == "probate"
    past = F.coalesce(c("sale_date") < today, F.lit(False))
    redeemable = F.coalesce(c("auction_status"), F.lit("")) == "in_redemption"
    closed = probate & F.coalesce(c("case_status").rlike("(?i)closed|dismissed|terminated"), F.lit(False))
    case = F.btrim("case_number")
    filed = F.expr("try_cast(left(trim(case_number), 4) as int)")
    sold = probate & F.coalesce(case.rlike("^[0-9]{4}") & (F.year("last_sale_date") >= filed), F.lit(False))
    price = F.when(F.coalesce(c("last_sale_price"), F.lit(0)) != 0, F.concat(F.lit(" for $"), number(c("last_sale_price")))).otherwise("")
    stale = F.when(~c("status").eqNullSafe("active"), F.concat(F.lit("status="), F.coalesce("status", F.lit("None")))).when(past & ~redeemable, "sale_date in past").when(closed, F.concat(F.lit("case "), "case_status"))
    stale = stale.when(sold, F.concat(F.lit("TRANSFERRED - parcel sold "), c("last_sale_date").cast("string"), price, F.lit(" (case filed "), filed.cast("string"), F.lit(")")))
    real = c("owner_name").isNotNull()
    tier = F.coalesce(F.nullif("match_confidence", F.lit("")), F.lit("legacy"))
    notes = F.array(
        F.when(past, "in redemption - live lead, sale_date past is expected"),
        F.when(real, F.concat(F.lit("parcel real (owner: "), "owner_name", F.lit(", mv=$"), number(c("current_market_value")), F.lit(")"))).otherwise("NO parcel registry match - confirm address"),
        F.when(probate, F.concat(F.lit("match="), tier)), F.when(probate & (tier == "unverified"), "name-only fuzzy join - verify owner==decedent"), F.when(probate & c("lead_age_days").isNotNull(), F.concat(F.lit("lead age: "), c("lead_age_days").cast("int").cast("string"), F.lit("d"))),
    )
    verdict = F.when(stale.isNotNull(), "STALE").when((probate & (tier == "unverified")) | ~real, "REVIEW").otherwise("VALID")
    return rows.withColumns({"verdict": verdict, "notes": F.when(stale.isNotNull(), F.array(stale)).otherwise(F.array_compact(notes))})
