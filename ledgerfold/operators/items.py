"""The row of a listing as readers get it: forty columns of its own, what its parcel and signals add, chips and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.links import street_view_url, verify_links
from ledgerfold.functions.names import is_entity
from ledgerfold.operators.migrations import evolved
from ledgerfold.operators.reading import chips, stack_signals

# Columns of a listing and of its parcel, in the order in which they are read.
LISTING = (
    "id string, source_site string, signal_type string, property_address string, property_city string, property_county string, property_state string, property_zip string, status string, pipeline_status string, "
    "sale_date date, sec_sale_date date, deposit_usd decimal(18,2), opening_bid_usd decimal(18,2), appraised_value_usd decimal(18,2), auction_status string, trustee_name string, case_number string, "
    "source_listing_id string, distress_stage string, case_status string, case_status_date date, match_method string, match_confidence string, match_score decimal(6,4), decedent_name string, case_title string, "
    "decedent_dod date, confirmation_order_date date, redemption_ends date, redemption_status string, redemption_window_days int, redemption_basis string, address_status string, conviction_tier string, "
    "blight_ticket_count int, blight_total_balance decimal(18,2), absentee_owner boolean, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
)
PARCEL = "owner_name string, situs_address string, current_market_value decimal(18,2), current_tax_balance decimal(18,2), delinquent_flag boolean, native_parcel_id string"
NO_OWNER = "(Owner not found)"
MONEY = ["deposit_usd", "opening_bid_usd", "appraised_value_usd", "match_score", "blight_total_balance", "current_market_value", "current_tax_balance"]


def base_rows(listings: DataFrame, parcels: DataFrame, signals: DataFrame) -> DataFrame:
    """The fifty columns that a listing is read with: its own, ``signal_count`` and ``type_counts``, and those of its parcel in its own market. Columns that a table lacks are null.

    ``registry_confirmed`` says that the register knows an owner; ``owner_is_entity`` is unknown without one.
    """
    keys = ["source_listing_id", "market"]
    own = evolved(listings, LISTING + ", market string")
    stacked = stack_signals(signals.withColumnRenamed("parcel_number", "source_listing_id"), tuple(keys))
    spine = evolved(parcels, "parcel_number string, market string, " + PARCEL).withColumnRenamed("parcel_number", "source_listing_id")
    joined = own.join(stacked, keys, "left").join(spine, keys, "left")
    owner = F.col("owner_name")
    derived = {"signal_count": F.coalesce("signal_count", F.lit(0).cast("long")), "owner_is_entity": is_entity(owner), "registry_confirmed": owner.isNotNull(), "owner_name": F.coalesce(owner, F.lit(NO_OWNER))}
    first = [c.split()[0] for c in LISTING.split(", ")]
    return joined.withColumns(derived).select(*first, "signal_count", "type_counts", "owner_name", "registry_confirmed", "owner_is_entity", "situs_address", "current_market_value", "current_tax_balance", "delinquent_flag", "native_parcel_id")


def items(rows: DataFrame, sources: dict[str, str | None], *, key: str | None = None) -> DataFrame:
    """Rows as readers get them: amounts as doubles, unknown flags as false, chips and their number, whether there are two or more, and the links. ``sources``: site to address; ``key``: of the street pictures."""
    known = {k: v for k, v in sources.items() if v}
    source = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("source_site")) if known else F.lit(None).cast("string")
    place = [F.col(f"property_{c}") for c in ("address", "city", "state", "zip")]
    out = rows.withColumn("signal_types", chips(F.col("signal_type"), F.col("type_counts"))).withColumns(
        {
            **{c: F.col(c).cast("double") for c in MONEY}, "delinquent_flag": F.coalesce("delinquent_flag", F.lit(False)), "signal_type_count": F.size("signal_types"), "is_hot": F.size("signal_types") >= 2,
            "street_view_url": street_view_url(*place, key), "verify_links": verify_links(*place, F.col("native_parcel_id"), F.col("source_listing_id"), source),
        }
    )
    return out.drop("type_counts", "native_parcel_id")
