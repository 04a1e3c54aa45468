"""Street addresses as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Long and short forms.
SUFFIX_FORMS = {"street": "st", "avenue": "ave", "drive": "dr", "road": "rd", "lane": "ln", "court": "ct", "place": "pl", "boulevard": "blvd", "circle": "cir"}
STREET_TYPES = {
    "road": "Rd", "rd": "Rd", "avenue": "Ave", "ave": "Ave", "drive": "Dr", "dr": "Dr", "street": "St", "st": "St", "court": "Ct", "ct": "Ct", "lane": "Ln", "ln": "Ln", "boulevard": "Blvd", "blvd": "Blvd",
    "circle": "Cir", "cir": "Cir", "place": "Pl", "pl": "Pl", "terrace": "Ter", "ter": "Ter", "parkway": "Pkwy", "pkwy": "Pkwy", "highway": "Hwy", "hwy": "Hwy", "trail": "Trl", "trl": "Trl", "square": "Sq", "sq": "Sq",
    "way": "Way", "loop": "Loop", "turn": "Turn",
}
DIRECTIONS = {"north": "N", "n": "N", "south": "S", "s": "S", "east": "E", "e": "E", "west": "W", "w": "W", "northeast": "NE", "ne": "NE", "northwest": "NW", "nw": "NW", "southeast": "SE", "se": "SE", "southwest": "SW", "sw": "SW"}
SHORT_DIRECTIONS = ["n", "s", "e", "w", "ne", "nw", "se", "sw"]
UNITS = ["apt", "apartment", "unit", "suite", "ste", "bldg", "building"]
CITIES = [
    "cleveland", "lakewood", "parma", "shaker heights", "euclid", "garfield heights", "maple heights", "westlake", "north olmsted", "brooklyn", "berea", "bedford", "bedford heights", "brecksville",
    "broadview heights", "independence", "mayfield heights", "middleburg heights", "olmsted falls", "parma heights", "pepper pike", "richmond heights", "rocky river", "seven hills", "solon",
    "south euclid", "university heights", "warrensville heights", "highland heights", "mayfield village", "newburgh heights", "north randall", "north royalton", "beachwood", "brook park",
    "chagrin falls", "cuyahoga heights", "fairview park", "gates mills", "glenwillow", "hunting valley", "linndale", "moreland hills", "oakwood village", "orange village", "valley view",
    "walton hills", "woodmere", "east cleveland", "cleveland heights", "strongsville", "olmsted twp", "oh",
]
#: Names of characters in HTML, as Python has them; those that may stand without a semicolon have none here.
ENTITIES = json.dumps(html5)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; keeps the generated code small where it is used often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(c: Column) -> Column:
    """Character references of HTML decoded, named (the longest name that fits, where the semicolon is missing) and numbered; what is none stays."""

    def number(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "([0-9A-Fa-f]+);?$", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
        fits = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def named(ref: Column) -> Column:
        names, name = F.from_json(F.lit(ENTITIES), "map<string,string>"), F.substring(ref, 2, 40)
        # without its semicolon a name may run into the word behind it
        lengths = F.sequence(F.greatest(F.length(name), F.lit(1)), F.lit(1), F.lit(-1))
        hit = F.get(F.filter(lengths, lambda n: F.element_at(names, name.substr(F.lit(1), n)).isNotNull()), F.lit(0))
        return F.when(hit.isNotNull(), F.concat(F.element_at(names, name.substr(F.lit(1), hit)), name.substr(hit + 1, F.lit(40)))).otherwise(ref)

    part = lambda x: F.when(x.rlike("^&#[xX]?[0-9A-Fa-f]+;?$"), number(x)).when(x.rlike("^&[A-Za-z]"), named(x)).otherwise(x)
    parts = F.regexp_extract_all(c, F.lit("&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, part), "")).otherwise(c)


def _known(mapping: dict[str, str], key: Column) -> Column:
    """The mapped value or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def capitalize(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t))))


def capitalize_words(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), capitalize), " ")


def canonical_city(c: Column) -> Column:
    """Entities decoded, spaces single, words capitalised; null for blank."""
    clean = F.btrim(F.regexp_replace(unescape(c), r"\s+", " "))
    return F.when(clean != "", capitalize_words(clean))


def canonical_county(c: Column) -> Column:
    return canonical_city(F.regexp_replace(F.btrim(c), r"(?i)\s+county\s*$", ""))


def canonical_address(c: Column) -> Column:
    """Street types and directions in their standard short forms, other words capitalised, a unit and what follows it unchanged.

    A direction counts from the second word on as long as only directions come before it; after the second word
    only short forms count.
    """
    single = F.btrim(F.regexp_replace(F.btrim(unescape(c)), r"\s+", " "))
    bare = lambda t: F.regexp_replace(F.lower(t), r"\.+$", "")
    is_unit = lambda t: F.lower(t).isin(UNITS) | t.startswith("#")
    fits = lambda t, i: (i == 0) | _known(DIRECTIONS, bare(t)).isNotNull() & ((i == 1) | bare(t).isin(SHORT_DIRECTIONS))

    def shorten(tokens: Column) -> Column:
        unit_at = F.array_position(F.transform(tokens, is_unit), True)
        cut = F.when(unit_at > 0, unit_at.cast("int") - 1).otherwise(F.size(tokens))
        typed = F.transform(F.slice(tokens, F.lit(1), cut), lambda t: F.coalesce(_known(STREET_TYPES, bare(t)), capitalize(t)))
        return F.concat(bind(typed, directed), F.slice(tokens, cut + 1, F.size(tokens)))

    def directed(typed: Column) -> Column:
        first_other = F.array_position(F.transform(typed, fits), False)
        upto = F.when(first_other > 0, first_other.cast("int") - 1).otherwise(F.size(typed))
        return F.transform(typed, lambda t, i: F.when((i > 0) & (i < upto), _known(DIRECTIONS, bare(t))).otherwise(t))

    return bind(single, lambda clean: F.when(clean != "", F.array_join(bind(F.split(clean, " "), shorten), " ")))


def match_address(c: Column) -> Column:
    """The address as a key for deduplication: lower case, short suffixes, letters and digits only, no state, zip or trailing city."""
    low = F.regexp_replace(F.lower(F.btrim(c)), r"\s+oh\s*[0-9]{5}(-[0-9]{4})?\s*$", "")
    low = reduce(lambda x, kv: F.regexp_replace(x, rf"\b{kv[0]}\b", kv[1]), SUFFIX_FORMS.items(), low)
    low = F.btrim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9 ]", ""), r"\s+", " "))

    def without_city(tokens: Column) -> Column:
        n = F.size(tokens)
        two, one = F.array_join(F.slice(tokens, F.greatest(n - 1, F.lit(1)), 2), " "), F.element_at(tokens, -1)
        return F.when((n >= 4) & two.isin(CITIES), F.slice(tokens, F.lit(1), F.greatest(n - 2, F.lit(0)))).when((n > 2) & one.isin(CITIES), F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(tokens)

    return F.array_join(bind(bind(F.split(low, " "), without_city), without_city), " ")


def loose_street_key(c: Column) -> Column:
    """House number and street without its type, directions short."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9 ]", "")), r"\s+"), lambda t: t != "")
    short = F.transform(tokens, lambda t: F.lower(F.coalesce(_known(DIRECTIONS, t), t)))
    typed = _known(STREET_TYPES, F.element_at(short, -1)).isNotNull()
    return F.when(F.size(tokens) > 0, F.array_join(F.when((F.size(short) > 2) & typed, F.slice(short, F.lit(1), F.greatest(F.size(short) - 1, F.lit(0)))).otherwise(short), " "))


def has_street_number(c: Column) -> Column:
    return c.rlike(r"^\s*[0-9]")


# Reasons, in the order in which they are tried, and the patterns of what is no address of one property.
ADDRESS_PROBLEMS = {
    "case_number_prefix": r"(?i)^\s*[0-9]{2}-CV-|^\s*[0-9]{2}-C-[0-9]|case no\.?\s*[0-9]", "legal_notice_text": r"(?i)notice of sale|notice of foreclosure", "multi_property_notice": r"(?i)\b(arta|et al)\b|i/r/t/a",
    "office_suite": r"(?i)\b(suite|ste\.?)\s*[0-9]", "malformed_address": r"^\s*[0-9]+\s*,",
}
LONGEST_ADDRESS = 150


def address_problem(c: Column) -> Column:
    """Why an address is no usable one; null if it is. Rules in order."""
    s = F.btrim(c, F.lit(" \t\r\n"))
    out = F.when(c.isNull() | (s == ""), "empty_address")
    for reason, pattern in ADDRESS_PROBLEMS.items():
        out = out.when(s.rlike(pattern), reason)
    return out.when(~s.rlike(r"^[0-9]+\s+\S"), "no_street_number").when(F.length(s) > LONGEST_ADDRESS, "address_too_long")


def zip5(c: Column) -> Column:
    """The last five-digit group that ends the text, with or without its extension."""
    return F.nullif(F.regexp_extract(F.btrim(c), r"([0-9]{5})(?:-[0-9]{4})?$", 1), F.lit(""))


def city_of(c: Column, state: str = "OH") -> Column:
    """The city before the state in 'street, city, ST zip'."""
    return F.nullif(F.btrim(F.regexp_extract(c, rf"(?i),\s*([A-Za-z .]+?),?\s*{state}\b", 1)), F.lit(""))


def absentee(mailing: Column, situs: Column) -> Column:
    """Whether the owner's mail goes to another zip; null if either is unknown."""
    return zip5(mailing) != zip5(situs)
