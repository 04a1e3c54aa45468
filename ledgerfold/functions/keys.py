"""Join keys from addresses, from loose to strict, as Column expressions. Null where there is no usable key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.addresses import DIRECTIONS, STREET_TYPES, _known, bind, canonical_address, match_address

# Street types that a strict key leaves out.
LAST_WORDS = "STREET ST AVENUE AVE ROAD RD DRIVE DR BOULEVARD BLVD COURT CT LANE LN PLACE PL TERRACE TER PARKWAY PKWY CIRCLE CIR TRAIL TRL WAY HEIGHTS HTS HIGHWAY HWY ROW ROUTE RTE".split()
COMPASS = {"N": "N", "S": "S", "E": "E", "W": "W", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W"}


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def plain_key(c: Column) -> Column:
    """Upper case, letters, digits and single spaces only."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.btrim(c)), "[^A-Z0-9 ]", ""), " +", " ")


def street_part(c: Column) -> Column:
    """What stands before the first comma, without a state and zip at the end."""
    single = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return _blank(F.btrim(F.split_part(F.regexp_replace(single, r"(?i),?\s+[A-Z]{2}\.?\s+[0-9]{5}(-[0-9]{4})?\s*$", ""), F.lit(","), F.lit(1))))


def any_zip(c: Column) -> Column:
    """The first five-digit group anywhere."""
    return _blank(F.regexp_extract(c, r"\b([0-9]{5})(?:-[0-9]{4})?\b", 1))


def zip_after_house(c: Column) -> Column:
    """The first five-digit group behind the first word, which may be a five-digit house number."""
    return _blank(F.regexp_extract(c, r"^\s*\S+\s.*?\b([0-9]{5})(?:-[0-9]{4})?\b", 1))


def street_zip_key(street: Column, zip_code: Column) -> Column:
    """``street|zip``, the street as for deduplication; an unknown zip leaves its place empty."""
    joined = lambda k: F.when(k != "", F.concat_ws("|", k, F.coalesce(zip_code, F.lit(""))))
    return bind(bind(canonical_address(street), match_address), joined)


def house_key(street: Column, zip_code: Column) -> Column:
    """``house|direction|street core|zip``; null without a house number or a core. Unit, city and street type are left out."""
    tokens = F.split(F.btrim(F.split_part(F.regexp_replace(F.upper(F.btrim(street)), r"\s+", " "), F.lit(","), F.lit(1))), " ")

    def key(t: Column) -> Column:
        towards = F.element_at(F.create_map(*[F.lit(x) for kv in COMPASS.items() for x in kv]), F.get(t, F.lit(1)))
        rest = F.slice(t, F.when(towards.isNull(), 2).otherwise(3), F.size(t))
        core = F.array_join(F.when(F.coalesce(F.get(rest, F.size(rest) - 1).isin(LAST_WORDS), F.lit(False)), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest), " ")
        house = F.get(t, F.lit(0))
        return F.when(house.rlike("^[0-9]+[A-Z]?$") & (core != ""), F.concat_ws("|", house, F.coalesce(towards, F.lit("")), core, F.coalesce(F.left(zip_code, F.lit(5)), F.lit(""))))

    return bind(tokens, key)


def city_free_key(c: Column, city: str = "detroit", state: str = "mi") -> Column:
    """Lower case without accents, punctuation, the city and all behind it, and state and zip."""
    plain = F.translate(F.lower(c), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    cut = F.regexp_replace(F.regexp_replace(plain, rf"(?s),?\s+{city}.*$", ""), rf"(?s),?\s+{state}\s+[0-9]{{5}}.*$", "")
    return _blank(F.btrim(F.regexp_replace(F.regexp_replace(cut, "[^a-z0-9 ]", " "), r"\s+", " ")))


def ordinal_key(c: Column) -> Column:
    """The key for deduplication with 128th and 128 made one."""
    return _blank(F.btrim(F.regexp_replace(F.regexp_replace(match_address(canonical_address(c)), r"\b([0-9]+)(st|nd|rd|th)\b", "$1"), r"\s+", " ")))


def same_address(a: Column, b: Column) -> Column:
    """Equal keys, or one begins the other; false if either has none."""
    x, y = ordinal_key(a), ordinal_key(b)
    return F.coalesce((x == y) | x.startswith(y) | y.startswith(x), F.lit(False))


def core_street(c: Column) -> Column:
    """The street's words without direction and type, upper case."""
    tokens = F.filter(F.split(plain_key(c), " "), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))
    return F.array_join(F.filter(tokens, lambda t: _known(DIRECTIONS, F.lower(t)).isNull() & _known(STREET_TYPES, F.lower(t)).isNull()), " ")
