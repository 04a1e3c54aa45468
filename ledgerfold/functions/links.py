"""Links of a listing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a listing is looked up.
HOMES = "https://www.zillow.com/homes/"
SEARCH = "https://www.google.com/search?q="
SEARCHED_SITE = "site:redfin.com "
TN_PARCEL = "https://apps2.shelbycountytrustee.com/Parcel?parcel="
TN_SEARCH = "https://apps2.shelbycountytrustee.com/PropertyClient"
OH_PARCEL = "https://myplace.cuyahogacounty.gov/?parcel="
OH_SEARCH = "https://myplace.cuyahogacounty.gov/"
REGISTRIES = {"TN": "Shelby Trustee", "OH": "Cuyahoga MyPlace"}
OTHER_REGISTRY = "County Registry"
STREET_VIEW = "https://maps.googleapis.com/maps/api/streetview"


def quote_plus(c: Column) -> Column:
    """Percent-encoded for a query: all but letters, digits and ``_.-~``, spaces as plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote(c: Column, *, slash: bool = True) -> Column:
    """Percent-encoded for a path: spaces as %20; slashes stay if ``slash``."""
    out = F.replace(quote_plus(c), F.lit("+"), F.lit("%20"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if slash else out


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def whole_address(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """Street, city, state and zip; an address with a comma is whole already."""
    return F.when(address.contains(","), address).otherwise(F.concat_ws(", ", *map(_filled, (address, city, state, zip_code))))


def verify_links(address: Column, city: Column, state: Column, zip_code: Column, native: Column, parcel: Column, source_url: Column) -> Column:
    """The links by which a listing is checked, as a struct: two by its address, one into the register of its state, and its source's."""
    whole, has = whole_address(address, city, state, zip_code), _filled(address).isNotNull()
    tn = F.when(_filled(native).isNotNull(), F.concat(F.lit(TN_PARCEL), quote(native, slash=False))).otherwise(TN_SEARCH)
    oh = F.when(_filled(parcel).isNotNull(), F.concat(F.lit(OH_PARCEL), quote(parcel))).otherwise(OH_SEARCH)
    label = F.when(state == "TN", REGISTRIES["TN"]).when(state == "OH", REGISTRIES["OH"]).otherwise(OTHER_REGISTRY)
    return F.struct(
        F.when(has, F.concat(F.lit(HOMES), quote(whole), F.lit("_rb/"))).alias("zillow"), F.when(has, F.concat(F.lit(SEARCH), quote(F.concat(F.lit(SEARCHED_SITE), whole)))).alias("redfin"),
        F.when(state == "TN", tn).when(state == "OH", oh).alias("registry"), label.alias("registry_label"), source_url.alias("source"),
    )


def street_view_url(address: Column, city: Column, state: Column, zip_code: Column, key: str | None, *, width: int = 600, height: int = 400) -> Column:
    """A street picture's address, of a listing in any form; null without a key or an address."""
    parts = F.concat_ws(", ", address, _filled(city), state, _filled(zip_code))
    url = F.concat(F.lit(f"{STREET_VIEW}?size={width}x{height}&location="), quote_plus(parts), F.lit(f"&pitch=10&source=outdoor&key={key}"))
    return F.when(F.lit(bool(key)) & address.isNotNull(), url)
