"""Values of parcels, cases, payloads and cards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.values import quoted

# Words in a sale's outcome that end a listing, and labels of sources by a part of their name, first match first.
CLOSED_OUTCOMES = ["sold", "forfeit", "withdrawn", "cancelled", "canceled", "vacated", "bankruptcy"]
SOURCE_LABELS = {"probate": "Probate", "sheriff": "Sheriff Sale", "land_bank": "Land Bank", "tax": "Tax", "violation": "Code Violation"}


def _blank(c: Column) -> Column:
    return F.nullif(F.btrim(c), F.lit(""))


# ---- safe values


def safe_number(c: Column) -> Column:
    return _blank(c).try_cast("double")


def safe_int(c: Column) -> Column:
    """Whole part of a number in text; null for anything else."""
    return F.when(_blank(c).rlike(r"^-?[0-9]+(\.[0-9]*)?$"), F.split_part(F.btrim(c), F.lit("."), F.lit(1)).try_cast("int"))


def positive(c: Column) -> Column:
    """Null for zero and less."""
    return F.when(c > 0, c)


def money_text(c: Column) -> Column:
    """Money as text with two decimals; null without a number."""
    d = F.regexp_replace(c, "[$,]", "").try_cast("decimal(18,2)")
    return d.cast("string")


def money_or_zero(c: Column) -> Column:
    """Currency signs and commas off; zero stays zero, anything else null."""
    return F.regexp_replace(F.btrim(c), "[$,]", "").try_cast("double")


# ---- parcels


def full_owner(first: Column, second: Column) -> Column:
    """Both owners' names, blank ones left out; null without any."""
    return _blank(F.concat_ws(" ", _blank(first), _blank(second)))


def situs(*parts: Column) -> Column:
    """House number, direction, street and type in a row; a house number of 0 is none."""
    return _blank(F.concat_ws(" ", *[F.nullif(_blank(p), F.lit("0")) for p in parts]))


def market_value(assessed: Column | None = None, total: Column | None = None, land: Column | None = None, building: Column | None = None) -> Column:
    """The appraised total, else land and building, else twice the assessed value; null unless positive."""
    parts = F.coalesce(land, F.lit(0)) + F.coalesce(building, F.lit(0)) if land is not None else F.lit(None)
    return F.coalesce(*[positive(x) for x in (total, parts, assessed * 2 if assessed is not None else None) if x is not None])


def comma_address(c: Column) -> tuple[Column, Column]:
    """Street and zip of 'street, city, state, zip'."""
    parts = F.split(c, ",")
    return _blank(F.get(parts, F.lit(0))), _blank(F.get(parts, F.lit(3)))


def pg_initcap(c: Column) -> Column:
    """Every run of letters and digits capitalised, whatever stands between them."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def lot_parcels(c: Column) -> Column:
    """Parcels of a list joined by commas, ampersands or 'and', each once; a marker of vacant lots is stripped."""
    clean = F.regexp_replace(c, r"(?i)\bvacant\s+(lot|land)s?\b[:\s]*", "")
    return F.array_distinct(F.filter(F.transform(F.split(clean, r"(?i)\s*(?:&|,|\band\b)\s*"), lambda x: F.btrim(x)), lambda x: x != ""))


# ---- taxes and cases


def owes_more_than_a_year(due: Column, *halves: Column) -> Column:
    """Taxes are due, and more than a year's."""
    annual = F.lit(0)
    for h in halves:
        annual = annual + F.coalesce(h, F.lit(0))
    return (due > 0) & (due > annual)


def delinquent_years(tape_year: Column, certified: Column) -> Column:
    """Age of a delinquency; null for impossible years."""
    age = tape_year - certified
    return F.when((certified > 0) & (age >= 0), age)


def valid_case(c: Column, categories: list[str]) -> Column:
    """A four-digit year, a category and a number."""
    return F.coalesce(F.upper(c).rlike(rf"^(19|20)[0-9]{{2}}\s?({'|'.join(categories)})\s?[0-9]+$"), F.lit(False))


def case_parts(c: Column) -> Column:
    """(year, kind, number) of a case number, leading zeros off; null if it is none."""
    part = lambda n: F.regexp_extract(F.upper(c), r"^\s*([0-9]{4})\s*-?\s*([A-Z]{2,3})\s*-?\s*0*([0-9]+)", n)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("year"), part(2).alias("kind"), part(3).alias("number")))


def notice_type(title: Column, body: Column) -> Column:
    """Signal type of a notice by its words: taxes before mortgages."""
    text = F.lower(F.concat_ws(" ", title, body))
    return F.when(text.rlike("delinquent tax|treasurer|tax lien"), "tax_delinquent_foreclosure").when(text.rlike("mortgage|bank|foreclosure"), "mortgage_foreclosure")


def sheriff_outcome(c: Column) -> Column:
    """(status, signal_type) of a sheriff's sale: a completed sale is no distress any more, a forfeit one still is."""
    low = F.lower(F.coalesce(c, F.lit("")))
    over = F.lit(False)
    for word in CLOSED_OUTCOMES:
        over = over | low.contains(word)
    return F.struct(F.when(over, "expired").otherwise("active").alias("status"), F.when(~(low.contains("sold") & ~low.contains("forfeit")), F.lit("tax_delinquent_foreclosure")).alias("signal_type"))


def auction_status(sale_date: Column, trustee: Column, as_of: Column) -> Column:
    return F.when(~trustee, "bank_owned").when(sale_date < as_of, "in_redemption").otherwise("scheduled")


def raised_score(c: Column, least: float = 0.96) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(least))


def surname_absent(decedent: Column, owner: Column) -> Column:
    """The decedent's last name ('LAST, FIRST') is nowhere in the owner's; false if either is unknown or the name has one letter."""
    last = F.upper(F.split_part(F.btrim(F.split_part(decedent, F.lit(","), F.lit(1))), F.lit(" "), F.lit(1)))
    return F.coalesce((F.length(last) >= 2) & ~F.contains(F.upper(owner), last) & (owner != ""), F.lit(False))


def demoted(confidence: Column, method: Column, mismatch: Column) -> Column:
    """Matches anchored in an address go to review where the owner has another surname."""
    return F.when(method.isin("address_anchor", "composite") & mismatch, "review").otherwise(confidence)


# ---- anchors of repeated batches


def tape_anchor(tape_date: Column, tax_year: Column) -> Column:
    """When a batch counts as observed: its tape's date, else the first day of its tax year; the same whenever it is read."""
    return F.coalesce(tape_date, F.make_date(tax_year, F.lit(1), F.lit(1)))


# ---- cards


def street_view(address: Column, key: str | None) -> Column:
    """Address of a street picture; null without a key or an address."""
    return F.when(F.lit(bool(key)) & _blank(address).isNotNull(), F.concat(F.lit("https://maps.example.com/streetview?size=640x400&location="), quoted(address), F.lit(f"&key={key}")))


def source_label(site: Column) -> Column:
    out = None
    for part, label in SOURCE_LABELS.items():
        out = F.when(F.contains(site, F.lit(part)), label) if out is None else out.when(F.contains(site, F.lit(part)), label)
    return out.otherwise(F.initcap(F.replace(site, F.lit("_"), F.lit(" "))))


def relative_time(then: Column, now: Column) -> Column:
    """'just now', minutes, hours or days ago; only whole minutes count, to the microsecond."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    minutes = F.floor(micros / 60_000_000)
    text = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(minutes < 1440, text(F.floor(minutes / 60), "h")).when(minutes.isNotNull(), text(F.floor(minutes / 1440), "d"))


def currency(c: Column) -> Column:
    """Whole dollars with thousands marked, halves to even; a dash for none. Less than half a dollar of debt is no dollar, without a sign."""
    return F.when(c.isNull(), "—").otherwise(F.concat(F.lit("$"), F.format_number(F.bround(c.cast("double"), 0), 0)))
