"""Person and owner names as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SUFFIXES = ["JR", "SR", "II", "III", "IV", "V"]
ENTITY_WORDS = (
    "LLC|L L C|INC|CORP|LTD|LP|COMPANY|CAPITAL|PROPERTIES|PROPERTY|HOLDINGS|HOLDING|INVESTMENT|INVESTMENTS|INVESTOR|INVESTORS|REALTY|REAL ESTATE|RENTAL|RENTALS|HOMES|GROUP|PARTNERS|VENTURES|"
    "ASSET|ASSETS|EQUITY|ENTERPRISE|ENTERPRISES|MANAGEMENT|DEVELOPMENT"
)
STRONG = 0.85


def is_entity(owner: Column) -> Column:
    """Whether an owner looks like a company; null for null."""
    return owner.rlike(rf"(?i)\b({ENTITY_WORDS})\b")


@lru_cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of each character in ASCII: those of which one letter stays, and those of which several do."""
    plain = lambda c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
    found = {c: p for c in map(chr, range(0x80, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (p := plain(c))}
    return {c: p for c, p in found.items() if len(p) == 1}, {c: p for c, p in found.items() if len(p) > 1}


def to_ascii(c: Column) -> Column:
    """Accents off, ligatures, fractions and letters in other shapes as their plain letters; what has no form in ASCII goes."""
    one, several = _decompositions()
    parts = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(parts, x), x)), "")
    whole = F.when(c.rlike("[" + "".join(several) + "]"), spread).otherwise(c)
    folded = F.regexp_replace(F.translate(whole, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def fold_name(name: Column) -> Column:
    """In ASCII, lower-cased, punctuation to spaces."""
    plain = F.lower(to_ascii(name))
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))


def _parts(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: (F.length(t) >= 2) & ~F.upper(t).isin(SUFFIXES))


def name_confidence(query: Column, candidate: Column) -> Column:
    """0 to 1: equal names 1; otherwise at least two parts of the query must each be strongly similar to a part of the candidate.

    The mean of the strong similarities; below two strong parts, half the best similarity; 0 for a query of fewer than two parts.
    """
    q, c = fold_name(query), fold_name(candidate)
    qs, cs = _parts(q), _parts(c)
    alike = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    best = F.transform(qs, lambda a: F.array_max(F.transform(cs, lambda b: alike(a, b))))
    strong = F.filter(best, lambda s: s >= STRONG)
    total = F.aggregate(strong, F.lit(0.0), lambda a, s: a + s)
    return (
        F.when(query.isNull() | candidate.isNull(), F.lit(None).cast("double"))
        .when(q == c, 1.0)
        .when((F.size(qs) < 2) | (F.size(cs) == 0), 0.0)
        .when(F.size(strong) < 2, F.bround(F.array_max(best) * 0.5, 4))
        .otherwise(F.bround(total / F.size(strong), 4))
    )


def _upper_parts(name: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(name, ",", " "), r"\s+"), lambda t: F.upper(F.btrim(t, F.lit(".,")))), lambda t: t != "")


def decedent_surname(name: Column) -> Column:
    """Before the comma if there is one, else the last part that is no suffix; null below two letters. An alias is cut off first."""
    own = F.btrim(F.element_at(F.split(name, r"(?i)\s+(?:a\.?k\.?a\.?|f\.?k\.?a\.?|n\.?k\.?a\.?)\s+"), 1))
    last = F.filter(_upper_parts(own), lambda t: ~t.isin(SUFFIXES))
    surname = F.when(own.contains(","), F.get(_upper_parts(F.element_at(F.split(own, ","), 1)), F.lit(0))).otherwise(F.get(last, F.size(last) - 1))
    return F.when(F.length(surname) >= 2, surname)


def owner_surname(name: Column) -> Column:
    """Registers put the surname first; null below two letters."""
    first = F.get(_upper_parts(name), F.lit(0))
    return F.when(F.length(first) >= 2, first)


def surname_mismatch(decedent: Column, owner: Column) -> Column:
    """True only if both surnames are known and differ."""
    return F.coalesce(decedent_surname(decedent) != owner_surname(owner), F.lit(False))


def name_key(name: Column) -> Column:
    """'SURNAME GIVEN' of a natural person in either order of writing; null for companies and single words."""
    parts = F.filter(_upper_parts(name), lambda t: ~t.isin(SUFFIXES) & (F.length(t) >= 2))
    comma = name.contains(",")
    surname, given = F.when(comma, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.size(parts) - 1)), F.when(comma, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.when(~is_entity(name) & (F.size(parts) >= 2), F.concat_ws(" ", surname, given))
