"""Landed pages of property registers and auction calendars, read by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.addresses import bind, unescape

# Labels of a property page and the fields that they fill; lines that are neither label nor value.
LABELS = {
    "Description": "legal_description", "Tax District Description": "tax_district", "School District": "school_district", "Property Class": "property_class", "Land Use": "land_use", "Ext Land Use": "ext_land_use",
    "Abt Land Use": "abt_land_use", "Tax Abatement": "tax_abatement", "Neighborhood Code": "neighborhood_code", "Total Associated Parcels": "total_associated_parcels", "Total Buildings": "total_buildings", "Gas": "util_gas",
    "Road Type": "road_type", "Electricity": "util_electricity", "Sewer": "util_sewer", "Water": "util_water", "Forest Land": "forest_land", "Mineral Rights": "mineral_rights", "Zoning Use": "zoning_use",
}
NO_VALUES = ["Top", "View Map"]
NO_TRANSFERS = "(?i)No Information Found|unable to find any Transfers"
#: Letters of a page behind the heading that are its transfers, and those in which it says that there are none.
TRANSFERS, APOLOGY = 12_000, 3_000


def lines_of(html: Column, element: str = "dataBody") -> Column:
    """The text lines of a page from the element of that class on, without blank ones."""
    body = F.regexp_extract(html, rf'(?is)<div[^>]*class="[^"]*\b{element}\b[^"]*"[^>]*>(.*)', 1)
    return F.filter(F.transform(F.split(F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]*>", "\n"), "\n"), lambda x: F.btrim(unescape(x))), lambda x: x != "")


def label_values(html: Column, labels: dict[str, str] | None = None) -> Column:
    """A page of labels and values as a struct of fields. A value is the line behind its label, unless that is a label itself; of a label that comes again the last value counts.

    The land use, code and description in one, comes as two fields.
    """
    labels = LABELS if labels is None else labels
    known = list(labels)

    def fields(lines: Column) -> Column:
        pairs = F.zip_with(lines, F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit(None).cast("string"))), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        pairs = F.filter(pairs, lambda p: p["k"].isin(known) & p["v"].isNotNull() & ~p["v"].isin(known + NO_VALUES))
        value = lambda label: F.try_element_at(F.filter(pairs, lambda p: p["k"] == label), F.lit(-1))["v"]
        return F.struct(*[value(label).alias(name) for label, name in labels.items()])

    read = bind(lines_of(html), fields)
    use, part = read["land_use"], r"^([0-9]+)\s*-\s*(.+)$"
    split = lambda n: F.when(use.rlike(part), F.btrim(F.regexp_extract(use, part, n)))
    rest = [read[name].alias(name) for name in labels.values() if name != "land_use"]
    return F.struct(*rest, *([split(1).alias("land_use_code"), split(2).alias("land_use_description")] if "land_use" in labels.values() else []))


def transfer_history(html: Column) -> Column:
    """(present, last_date, last_price, transfers) of the transfers on a property page: dates that are labelled as such, else any; the first amount, as the newest comes first."""

    def read(block: Column) -> Column:
        dates = lambda pattern: F.regexp_extract_all(block, F.lit(pattern), F.lit(1))
        labelled, any_ = dates(r"Transfer Date:\s*([0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})"), dates(r"\b([0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2})\b")
        days = F.filter(F.transform(F.when(F.size(labelled) > 0, labelled).otherwise(any_), lambda d: F.try_to_timestamp(d, F.lit("M/d/yyyy")).cast("date")), lambda d: d.isNotNull())
        price = F.regexp_extract(block, r"(?i)Sales Amt[^$]*\$([0-9,]+(?:\.[0-9]{2})?)", 1)
        there = (block != "") & ~F.substring(block, 1, APOLOGY).rlike(NO_TRANSFERS)
        n = F.when(there, F.size(days)).otherwise(0)
        return F.struct((n > 0).alias("present"), F.when(n > 0, F.array_max(days)).alias("last_date"), F.when(n > 0, F.replace(F.nullif(price, F.lit("")), F.lit(","), F.lit("")).try_cast("double")).alias("last_price"), n.alias("transfers"))

    page = F.coalesce(html, F.lit(""))
    at = F.instr(F.lower(page), "<h3>transfer history</h3>")
    return bind(F.when(at > 0, page.substr(at, F.lit(TRANSFERS))).otherwise(""), read)


# Weekdays (Monday is 0) on which a county sells, and what.
SALE_DAYS = {4: "mortgage_foreclosure", 1: "tax_delinquent_foreclosure"}
#: Letters within which a day of the calendar that has a sale says so, before the next day begins.
NEAR = 800


def calendar_sales(html: Column, today: Column, days: dict[int, str] | None = None) -> Column:
    """An array of (day, signal_type): the days of a calendar, from today on, that have an entry and fall on a known weekday."""
    dayid = rf"""(?s)dayid=['"]\s*([0-9/]+)\s*['"][^>]*>(?=(?:(?!dayid=).){{0,{NEAR}}}?CALTEXT)"""
    found = F.transform(F.regexp_extract_all(html, F.lit(dayid), F.lit(1)), lambda d: F.try_to_timestamp(d, F.lit("M/d/yyyy")).cast("date"))
    kind = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in (days or SALE_DAYS).items() for x in kv]), F.weekday(d))
    typed = F.transform(F.filter(found, lambda d: d >= today), lambda d: F.struct(d.alias("day"), kind(d).alias("signal_type")))
    return F.filter(typed, lambda x: x["signal_type"].isNotNull())
