"""Entity resolution: records to parcels by unique exact keys, loose keys and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.addresses import bind
from ledgerfold.functions.names import _parts, fold_name, name_confidence


#: Blocks that hold this share of all entries and that many are split; there are at most as many as the inverse of the share.
HOT_SHARE, HOT_LEAST = 1 / 1000, 1000


def unique_keys(spine: DataFrame, key: Column, parcel: str = "parcel_number") -> DataFrame:
    """(key, parcel) for keys that belong to exactly one parcel. Pre-aggregated: least and greatest must agree."""
    keyed = spine.select(key.alias("key"), F.col(parcel).alias("parcel")).filter("key is not null and key <> ''")
    return keyed.groupBy("key").agg(F.min("parcel").alias("parcel"), F.max("parcel").alias("other")).filter("parcel = other").select("key", "parcel")


def resolve_unique(records: DataFrame, key: Column, spine: DataFrame, spine_key: Column, parcel: str = "parcel_number", out: str = "resolved") -> DataFrame:
    """Adds the parcel of the record's key, null if the key is unknown or ambiguous."""
    known = unique_keys(spine, spine_key, parcel)
    return records.withColumn("_key", key).join(known.select(F.col("key").alias("_key"), F.col("parcel").alias(out)), "_key", "left").drop("_key")


def cap_ambiguous(candidates: DataFrame, record: str, parcel: str, cap: int = 5) -> DataFrame:
    """Records with at most ``cap`` candidate parcels; the others resolve to nothing."""
    counts = candidates.groupBy(record).agg(F.count_distinct(parcel).alias("_n")).filter(F.col("_n") <= cap).select(record)
    return candidates.join(counts, record, "left_semi")


def _part_keys(part: Column) -> Column:
    """Keys of which two parts with a similarity of ``STRONG`` (0.85) or more share one.

    Below seven letters such parts are equal. Up to 13 they differ by one edit, so they agree in the first three letters or in the last three. From 14
    letters on, edits leave a run of four letters or more untouched; the other part then has at least 12.
    """
    n = F.length(part)
    tail = F.when(n >= 6, F.array(F.concat(F.lit("$"), F.substring(part, -3, 3)))).otherwise(F.array())
    runs = F.when(n >= 12, F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: part.substr(i, F.lit(4)))).otherwise(F.array())
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), F.substring(part, 1, 3))), tail, runs))


def fuzzy_name_join(queries: DataFrame, owners: DataFrame, *, query: str, owner: str, least: float = 0.75) -> DataFrame:
    """Pairs whose names agree with confidence of at least ``least``, and the confidence.

    ``least`` must be above 0.5, so names must be equal, or two parts of the query each strongly similar to a part of the owner, which may be the same. Two
    strongly similar parts share a key (see :func:`_part_keys`), so names are blocked on pairs of keys of two parts, by position, and on the
    folded name; no pair is missed. Each pair is verified in the first of the blocks that it shares, so nothing has to be made one afterwards. Blocks are counted:
    those that hold much of the owners (at most 1 / ``HOT_SHARE`` of them) are split by the hash of the owner, and the queries that ask for them repeated as often. Equal names
    should be made one before the call.
    """
    least_confidence = least
    if not least > 0.5:
        raise ValueError("least must be above 0.5")
    q = queries.withColumn("_q", F.struct(*queries.columns))
    o = owners.withColumn("_o", F.struct(*owners.columns))

    def blocks(name: str, first: int) -> Column:
        """Pairs of parts at least ``first`` places apart; 0 also pairs a part with itself."""
        both = lambda xs, ys: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.concat(F.least(x, y), F.lit(" "), F.greatest(x, y)))))
        pairs = lambda ks: F.flatten(F.transform(ks, lambda x, i: F.flatten(F.transform(F.slice(ks, i + 1 + first, F.size(ks)), lambda y: both(x, y)))))
        keys = F.transform(_parts(fold_name(F.col(name))), _part_keys)
        return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), fold_name(F.col(name)))), bind(keys, pairs)))

    left = q.withColumn("_asked", blocks(query, 1)).select("_q", "_asked", F.explode("_asked").alias("_block"))
    right = o.withColumn("_has", blocks(owner, 0)).select("_o", "_has", F.explode("_has").alias("_block"))
    counts = right.groupBy("_block").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = counts.filter(F.col("_n") >= least).select("_block", (F.floor(F.col("_n") / least) + 1).cast("bigint").alias("_parts"))
    salts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    left = left.join(F.broadcast(hot), "_block", "left").withColumn("_salt", F.explode(F.sequence(F.lit(1).cast("bigint"), salts))).drop("_parts")
    right = right.join(F.broadcast(hot), "_block", "left").withColumn("_salt", F.pmod(F.xxhash64("_o"), salts) + 1).drop("_parts")
    first = F.get(F.filter("_asked", lambda x: F.array_contains("_has", x)), F.lit(0))
    pairs = left.join(right, ["_block", "_salt"]).filter(F.col("_block") == first)
    scored = pairs.select("_q", "_o", name_confidence(F.col(f"_q.{query}"), F.col(f"_o.{owner}")).alias("confidence"))
    return scored.filter(F.col("confidence") >= least_confidence).select("_q.*", "_o.*", "confidence")


def merge_readers(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of two readers by key: the first reader's values win, the second fills what is null, empty or zero."""
    values = [c for c in first.columns if c != key]

    def blank_to_null(df: DataFrame, rank: int) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(key, F.lit(rank).alias("_rank"), *[F.nullif(c, F.lit("" if kinds[c] == "string" else 0)).alias(c) if kinds[c] != "date" else F.col(c) for c in values])

    both = blank_to_null(first, 1).unionByName(blank_to_null(second, 2))
    return both.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in values])


def live_and_survey(live: DataFrame, survey: DataFrame, key: str) -> DataFrame:
    """Live rows, with the survey's grade where there is one, and survey rows that no live row covers."""
    graded = live.join(survey.select(key, "grade"), key, "left").withColumn("origin", F.lit("live"))
    rest = survey.join(live.select(key), key, "left_anti").withColumn("origin", F.lit("survey"))
    return graded.unionByName(rest, allowMissingColumns=True)
