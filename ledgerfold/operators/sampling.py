"""Exact samples by the hash of a key: the same rows wherever and whenever it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.storage import stored


def drawn_order(key: str, seed: int) -> Column:
    """60 bits of an MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def lowest(records: DataFrame, n: Column | int, key: str, *, stratum: str | None = None, seed: int = 7) -> DataFrame:
    """The ``n`` rows with the lowest hashes of each stratum, or of all; fewer where there are fewer. Ties go to the smaller key; null strata are a stratum, null keys are left out.

    Two passes: strata are counted, which gives a threshold that a little more than ``n`` rows stay below; only the hashes of those are gathered, and the last that belongs
    to the sample is read off. A stratum that falls short, which is as good as never, is passed again with a threshold twice as high. No stratum is sorted, and no row
    is moved that is not nearly in the sample. Keys should be unique.
    """
    rows = records.filter(F.col(key).isNotNull()).withColumn("_s", F.col(stratum).cast("string") if stratum else F.lit(""))
    rows = rows.withColumn("_at", F.struct(drawn_order(key, seed).alias("h"), F.col(key).alias("k")))
    size = n if isinstance(n, Column) else F.lit(n)
    counts = stored(rows.groupBy("_s").agg(F.count("*").alias("_n")).withColumn("_want", F.least(size.cast("bigint"), F.col("_n"))).filter("_want > 0"), "strata")
    most, slack, cuts, done = float(1 << 60), 1.0, None, None
    left = counts
    while True:
        share = slack * (F.col("_want") + 8 * F.sqrt("_want") + 16) / F.col("_n")
        bounds = left.withColumn("_top", F.when(share < 1, (share * most).cast("bigint")).otherwise(F.lit((1 << 60) - 1)))
        near = rows.join(bounds, rows["_s"].eqNullSafe(bounds["_s"])).drop(rows["_s"]).filter(F.col("_at.h") <= F.col("_top"))
        got = stored(near.groupBy("_s", "_want", "_n").agg(F.sort_array(F.collect_list("_at")).alias("_low")), "lowest")  # about as many as wanted
        found = got.filter(F.size("_low") >= F.col("_want")).select("_s", F.element_at("_low", F.col("_want").cast("int")).alias("_last"))
        cuts = found if cuts is None else cuts.unionByName(found)
        left = counts.join(cuts.select(F.col("_s").alias("_done")), F.col("_s").eqNullSafe(F.col("_done")), "left_anti")
        if left.isEmpty():
            break
        slack *= 2
    return rows.join(cuts, rows["_s"].eqNullSafe(cuts["_s"])).filter(F.col("_at") <= F.col("_last")).select(*[rows[c] for c in records.columns])


def quotas_and_fill(records: DataFrame, stratum: str, strata: list[str], quota: int, target: int, key: str, *, seed: int = 7) -> DataFrame:
    """``quota`` rows of each of the given strata and, if these are less than ``target``, rows of any stratum that were not taken yet, up to ``target``. ``filled`` marks the latter."""
    taken = stored(lowest(records.filter(F.col(stratum).isin(strata)), quota, key, stratum=stratum, seed=seed), "taken")
    short = target - taken.count()
    marked = taken.withColumn("filled", F.lit(False))
    if short <= 0:
        return marked
    rest = records.join(taken.select(key), key, "left_anti")
    return marked.unionByName(lowest(rest, short, key, seed=seed + 1).select(*records.columns).withColumn("filled", F.lit(True)))
