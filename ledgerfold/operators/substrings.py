"""Joins on 'text contains pattern', by an inverted index of q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram, and grams that are looked up with salts: those that hold this share of the index or more. There are at most as many as the share's inverse.
GRAM = 3
HOT_SHARE = 1 / 1000


def _fragments(pattern: Column, wildcards: bool) -> Column:
    """The literal runs of a pattern, in lower case."""
    low = F.lower(pattern)
    return F.filter(F.split(low, "[%_]"), lambda f: f != "") if wildcards else F.filter(F.array(low), lambda f: f != "")


def _grams(fragments: Column, size: Column) -> Column:
    """All different runs of ``size`` letters."""
    of = lambda f: F.transform(F.sequence(F.lit(1), F.greatest(F.length(f) - size + 1, F.lit(1))), lambda i: f.substr(i, size))
    return F.array_distinct(F.flatten(F.transform(F.filter(fragments, lambda f: F.length(f) >= size), of)))


def contains_join(queries: DataFrame, texts: DataFrame, *, patterns: list[str], text: str, block: tuple[str, ...] = (), wildcards: bool = False, gram: int = GRAM) -> DataFrame:
    """Pairs of rows where ``text`` contains each of the query's ``patterns``, whatever the case, and the ``block`` columns, which both sides have, are equal.

    The texts are indexed by block and q-gram. A query is looked up by its rarest gram only, so a frequent word costs nothing if the pattern has a rarer part, and
    what is found is verified. No pair is lost: a text that contains a pattern has all its grams; a pattern without ``gram`` letters in a row is looked up by a shorter one.
    With ``wildcards`` the signs ``%`` and ``_`` stand for any letters and for any one letter, as in LIKE; else for themselves.

    Queries that ask the same are looked up once. The grams that hold much of the index are split by the hash of the text, into as many parts as their count asks for. Null
    patterns, texts and blocks, and patterns without a letter of their own, match nothing. Columns of the two sides must differ but for the block.
    """
    p = queries.select(*block, *patterns).distinct().withColumn("_f", F.flatten(F.array(*[_fragments(F.col(c), wildcards) for c in patterns])))
    p = p.filter(F.size("_f") > 0)
    for c in (*block, *patterns):
        p = p.filter(F.col(c).isNotNull())
    p = p.withColumn("_size", F.least(F.lit(gram), F.array_max(F.transform("_f", F.length))))
    sizes = sorted(r[0] for r in p.select("_size").distinct().collect())  # at most ``gram`` numbers
    if not sizes:
        return queries.join(texts.drop(*block), F.lit(False))
    known = texts.filter(F.col(text).isNotNull())
    all_grams = F.array_distinct(F.flatten(F.array(*[_grams(F.array(F.lower(text)), F.lit(s)) for s in sizes])))
    index = known.withColumn("_gram", F.explode(all_grams))

    counts = index.groupBy(*block, "_gram").agg(F.count("*").alias("_n"))
    rarest = F.min_by(F.struct("_gram", "_n"), F.struct("_n", "_gram")).alias("_g")
    asked = p.select(*block, *patterns, F.explode(_grams(F.col("_f"), F.col("_size"))).alias("_gram")).join(counts, [*block, "_gram"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    asked = asked.groupBy(*block, *patterns).agg(rarest).select(*block, *patterns, "_g.*")

    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(1, int(total * HOT_SHARE))
    parts = F.least(F.floor(F.col("_n") / least) + 1, F.lit(256)).cast("int")
    hot = counts.filter(F.col("_n") >= least).select(*block, "_gram", parts.alias("_parts"))  # at most 1 / HOT_SHARE rows
    right = index.join(F.broadcast(hot), [*block, "_gram"], "left").withColumn("_salt", F.pmod(F.xxhash64(text), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    salts = F.when(F.col("_n") >= least, parts).otherwise(F.lit(1))
    left = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (salts - 1).cast("bigint")))).drop("_n")
    met = left.join(right, [*block, "_gram", "_salt"]).drop("_gram", "_salt")
    for c in patterns:
        met = met.filter(F.like(F.lower(text), F.concat(F.lit("%"), F.lower(c), F.lit("%")))) if wildcards else met.filter(F.contains(F.lower(text), F.lower(c)))
    return queries.join(met, [*block, *patterns])


# The street types that are cut off before a street is looked up.
CUT_TYPES = [
    "drive", "dr", "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "court", "ct", "boulevard", "blvd", "way", "place", "pl", "circle", "cir", "trail", "trl", "terrace", "ter", "parkway", "pkwy",
    "highway", "hwy", "square", "sq", "loop", "run", "path", "point", "pt", "crossing", "xing",
]
STREET_LETTERS = 20


def house_and_street(address: Column) -> tuple[Column, Column]:
    """The house number (digits) and the first 20 letters of the street without its type; both null if there is no number or the street has less than three letters."""
    parts = F.filter(F.split(address, r"\s+"), lambda x: x != "")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    typed = (F.size(rest) >= 2) & F.btrim(F.lower(F.get(rest, F.size(rest) - 1)), F.lit(".")).isin(CUT_TYPES)
    street = F.array_join(F.when(typed, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest), " ")
    usable = F.get(parts, F.lit(0)).rlike(r"^[0-9]+$") & (F.length(street) >= 3)
    return F.when(usable, F.get(parts, F.lit(0))), F.when(usable, F.substring(street, 1, STREET_LETTERS))


def address_candidates(queries: DataFrame, spine: DataFrame, *, address: str = "address", situs: str = "situs_address") -> DataFrame:
    """Parcels whose address contains the query's house number and street, both anywhere; the street's type does not count, as registers shorten it. ``%`` and ``_`` are wildcards."""
    house, street = house_and_street(F.col(address))
    return contains_join(queries.withColumn("_house", house).withColumn("_street", street), spine, patterns=["_house", "_street"], text=situs, wildcards=True).drop("_house", "_street")


def addresses_on_block(queries: DataFrame, spine: DataFrame, *, address: str = "address", situs: str = "situs_address") -> DataFrame:
    """Parcels whose address begins with the query's house number and contains the query's street word; the number is the block, the word is taken literally."""
    word = lambda c, n: F.get(F.split(F.btrim(c), " +"), F.lit(n))
    asked = queries.withColumn("_house", word(F.col(address), 0)).withColumn("_street", F.nullif(word(F.col(address), 1), F.lit("")))
    return contains_join(asked, spine.withColumn("_house", word(F.col(situs), 0)), patterns=["_street"], text=situs, block=("_house",)).drop("_house", "_street")
