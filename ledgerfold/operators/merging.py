"""Set-wise upserts: batches are collapsed, then merged with the current snapshot in one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerfold.functions.values import is_delinquent


def collapse(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: for each column the last non-null value in order of ``seq``, as if the rows came one by one."""
    rest = [c for c in batch.columns if c not in (*keys, seq)]
    return batch.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], *, overwrite: tuple[str, ...] = (), keep: tuple[str, ...] = (), mark_changes: bool = False) -> DataFrame:
    """``current`` with ``batch`` merged in: new values win where they are not null.

    Columns in ``overwrite`` take the new value even if null, columns in ``keep`` the old one if there is one. Both sides have one row a key; null
    keys equal each other. ``is_new`` marks inserted rows; ``mark_changes`` adds ``came``, whether the batch has the row, and ``is_changed``, whether an old row's values differ now (nulls compare as values).
    Columns of the batch that ``current`` lacks are left out.
    """
    a, b = current.alias("a"), batch.withColumn("_new", F.lit(True)).alias("b")
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    joined = a.withColumn("_old", F.lit(True)).join(b, on, "full_outer")
    old, new = F.col("_old"), F.col("_new")

    def value(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}") if c in batch.columns else F.lit(None)
        if c in overwrite:
            return F.when(new, y).otherwise(x)
        if c in keep:
            return F.coalesce(x, y)
        return F.coalesce(y, x)

    marks = [old.isNull().alias("is_new")]
    if mark_changes:
        differs = F.lit(False)
        for c in current.columns:
            differs |= ~value(c).eqNullSafe(F.col(f"a.{c}"))
        marks += [new.isNotNull().alias("came"), (old.isNotNull() & differs).alias("is_changed")]
    return joined.select(*[value(c).alias(c) for c in current.columns], *marks)


def write_counted(merged: DataFrame, path: str | None, *, mode: str = "errorifexists") -> dict[str, int]:
    """Writes a merged table with marks (see :func:`upsert`) without them, and counts in the same pass: ``rows``, ``inserted``, ``updated``, ``confirmed`` (came, but
    changed nothing) and ``untouched``. Without a path it is a dry run: the same plan runs and counts, and nothing is written."""
    counts = Observation()
    old = ~F.col("is_new")
    watched = merged.observe(
        counts, F.count(F.lit(1)).alias("rows"), F.count_if("is_new").alias("inserted"), F.count_if(old & F.col("is_changed")).alias("updated"), F.count_if(old & F.col("came") & ~F.col("is_changed")).alias("confirmed"),
        F.count_if(old & ~F.col("came")).alias("untouched"),
    ).drop("is_new", "came", "is_changed")
    if path is None:
        watched.write.format("noop").mode("overwrite").save()
    else:
        watched.write.mode(mode).parquet(path)
    return counts.get


#: Columns of a parcel that an update overwrites even with null.
PARCEL_OVERWRITE = ("source_url", "last_seen", "property_state")


def upsert_parcels(current: DataFrame, batch: DataFrame, *, balance: str = "current_tax_balance", flag: str = "delinquent_flag") -> DataFrame:
    """Parcels merged by number and market: empty texts count as unknown, known values stay where the new ones are unknown, the page, the day and the state are
    always those of the batch, and the delinquency flag follows from the flag or the balance that came."""
    keys = ["parcel_number", "market"]
    texts = [c for c, kind in batch.dtypes if kind == "string" and c not in keys]
    clean = batch.withColumns({c: F.nullif(F.btrim(c), F.lit("")) for c in texts}).withColumn(flag, is_delinquent(F.col(flag), F.col(balance)))
    return upsert(current, clean, keys, overwrite=PARCEL_OVERWRITE)


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks, one each (insert, on conflict do nothing)."""
    return rows.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti")


def stub_parcels(listings: DataFrame, parcels: DataFrame) -> DataFrame:
    """Parcels for listings that point to none; the smallest listing id lends its address."""
    wanted = listings.filter("parcel_number is not null and parcel_number <> ''").groupBy("parcel_number", "market").agg(F.min_by("property_address", "id").alias("situs_address"))
    return wanted.join(parcels.select("parcel_number", "market"), ["parcel_number", "market"], "left_anti").withColumn("source_url", F.lit("stub:listing"))


def overlay_changed(current: DataFrame, changes: DataFrame, key: str, columns: list[str], *, keep_old: bool = True) -> DataFrame:
    """Rows whose values differ from the changes (nulls compare as values), with the new values; an unknown new value keeps the old one, or with ``keep_old`` off replaces it."""
    joined = current.alias("a").join(changes.alias("b"), key)
    new = {c: F.coalesce(f"b.{c}", f"a.{c}") if keep_old else F.col(f"b.{c}") for c in columns}
    differs = F.lit(False)
    for c, x in new.items():
        differs |= ~F.col(f"a.{c}").eqNullSafe(x)
    return joined.filter(differs).select(key, *[x.alias(c) for c, x in new.items()])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose value was added, removed or changed."""
    a, b = before.select(key, F.col(column).alias("old"), F.lit(1).alias("in_old")), after.select(key, F.col(column).alias("new"), F.lit(1).alias("in_new"))
    both = a.join(b, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")) | F.col("in_old").isNull() | F.col("in_new").isNull())
    return both.select(key, "old", "new", F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed").alias("change"))
