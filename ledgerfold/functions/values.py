"""Money, dates, statuses and signal dimensions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dimension of a signal type; others are named after themselves.
DIMENSIONS = {
    "land_bank_inventory": "Land Bank", "tax_delinquent_foreclosure": "Tax Foreclosure", "forfeited_land": "Tax Deed (Forfeited Land)", "mortgage_foreclosure": "Foreclosure (Mortgage)", "probate": "Probate",
    "code_violation": "Code Violation", "code_violation_task": "Code Violation", "blight_violation": "Code Violation", "tax_foreclosure": "Tax Distress", "cert_pending": "Tax Distress", "cert_sold": "Tax Distress",
    "tax_payment_plan": "Tax Distress", "tax_delinquent": "Tax Distress", "tax_deed": "Tax Distress",
}
DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MMMM d, yyyy"]


def dimension(raw: Column) -> Column:
    """Null and '' have none."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv]), raw)
    return F.when(raw != "", F.coalesce(named, F.initcap(F.replace(raw, F.lit("_"), F.lit(" ")))))


def money(c: Column) -> Column:
    """A decimal from text with currency signs and commas; null without one number, or for 0."""
    d = F.regexp_replace(c, r"[^0-9.]", "").try_cast("decimal(18,2)")
    return F.when(d > 0, d)


def any_date(c: Column, latest: Column | None = None) -> Column:
    """The first format that reads the text; null for years before 1900 and, if given, days after ``latest``. Ordinal endings are dropped."""
    s = F.regexp_replace(F.btrim(c), r"(?i)\b([0-9]{1,2})(st|nd|rd|th)\b", "$1")
    shapes = [r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", r"^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$", r"^[0-9]{8}$", r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$"]
    cased = F.initcap(F.lower(F.replace(s, F.lit("-"), F.lit(" "))))  # month names are read in this case only
    texts = [s, s, s, F.replace(cased, F.lit(" "), F.lit("-")), s, cased]
    tries = [F.when(s.rlike(shape), F.try_to_date(text, fmt)) for shape, text, fmt in zip(shapes, texts, DATE_FORMATS, strict=True)]
    d = F.coalesce(*tries)
    return F.when((F.year(d) >= 1900) & ((d <= latest) if latest is not None else F.lit(True)), d)


def epoch_date(millis: Column) -> Column:
    return F.to_date(F.timestamp_millis(millis))


def case_digits(c: Column) -> Column:
    """The digits of a case number."""
    return F.regexp_replace(c, "[^0-9]", "")


def case_base(c: Column) -> Column:
    """A case number without its sequence in parentheses; spaces single."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\s*\([0-9]+\)\s*$", ""), r"\s+", " "))


def violation_bucket(status: Column) -> Column:
    s = F.lower(status)
    return F.when(s.contains("close") | s.contains("resolved") | s.contains("complete"), "Closed").when(s.contains("pend"), "Pending").when(s.contains("open") | s.contains("active"), "Open").otherwise("Unknown")


def is_delinquent(flag: Column, balance: Column) -> Column:
    """True by flag or by a positive balance; unknown otherwise."""
    return F.when(flag | (balance > 0), F.lit(True))


def match_class(method: Column, confidence: Column) -> Column:
    """confirmed for composite and address matches, probable for names from 0.9, unverified below."""
    return F.when(method.isin("composite", "address_anchor"), "confirmed").when((method == "name_match") & (confidence >= 0.9), "probable").when(method.isNotNull(), "unverified")


def eastern_day(ts: Column) -> Column:
    """The calendar day in New York of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def sale_type(appraised: Column) -> Column:
    """mortgage or tax sale: appraised at nothing means tax."""
    return F.when(F.coalesce(appraised, F.lit(0)) == 0, "tax_delinquent_foreclosure").otherwise("mortgage_foreclosure")


def quoted(c: Column) -> Column:
    """Percent-encoded for a path: spaces as %20, slashes kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
