"""Parcel identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(c: Column, n: int, left: bool = True) -> Column:
    """Zeros up to ``n`` characters; longer strings stay whole (Spark's own pads cut them)."""
    return F.when(F.length(c) >= n, c).otherwise((F.lpad if left else F.rpad)(c, n, "0"))


def parcel_number(raw: Column) -> Column:
    """The canonical parcel number; rules in order, the first that fits wins. Null and blank give null."""
    s = F.btrim(raw)
    upper = F.upper(s)
    digits = F.regexp_replace(s, r"[^0-9]", "")
    packed = F.regexp_replace(upper, r"[-\s]", "")
    lettered = s.rlike("[A-Za-z]")
    # a map sheet and a group in it: sheet to six places, a zero, group to six places, a qualifier (0 if there is none)
    pair = r"^([A-Z0-9]{4,7})\s+([A-Z0-9]{5,7})$"
    sheet, group = F.regexp_extract(upper, pair, 1), F.regexp_extract(upper, pair, 2)
    bare, qualifier = F.regexp_replace(group, "[A-Z]$", ""), F.regexp_extract(group, "([A-Z])$", 1)
    from_pair = F.concat(F.substring(_pad(sheet, 6, left=False), 1, 6), F.lit("0"), _pad(bare, 6), F.coalesce(F.nullif(qualifier, F.lit("")), F.lit("0")))
    from_digits = F.concat(F.substring(s, 1, 6), F.lit("0"), _pad(F.substring(s, 7, 5), 6), F.lit("0"))
    return (
        F.when(raw.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{3}$"), s)
        .when(s.rlike(r"^[0-9]{8}(\.[0-9]*[A-Za-z]?|-[0-9]+)$"), upper)
        .when(F.length(digits) == 8, F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 3)))
        .when(~lettered & F.length(digits).between(1, 7), _pad(digits, 7))
        .when(upper.rlike(r"^[A-Z0-9]{14}$"), upper)
        .when(upper.rlike(pair), from_pair)
        .when(packed.rlike(r"^[A-Z][0-9]{11,12}$"), packed)
        .when(s.rlike(r"^[0-9]{10,11}$"), from_digits)
        .otherwise(upper)
    )


def parcel_number_lucas(raw: Column) -> Column:
    """Digits, padded to seven; a final S (condominium) stays."""
    s = F.upper(F.btrim(raw))
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return (
        F.when(raw.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(s.rlike("S$") & (digits != ""), F.concat(digits, F.lit("S")))
        .when(digits == "", s)
        .otherwise(_pad(digits, 7))
    )


def parcel_number_for(raw: Column, market: Column) -> Column:
    """The market's own rule; other markets and null use the general one."""
    return F.when(market == "lucas", parcel_number_lucas(raw)).otherwise(parcel_number(raw))
