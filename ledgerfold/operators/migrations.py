"""Ordered, recorded changes of stored tables, with guards; and the backfill of markets that such changes need.

A database is a folder: each table has snapshots ``<table>/v=<n>``, and the ledger has one small file for each migration that was applied, with the versions that
the tables had after it. The last entry is what counts. A migration writes new snapshots first and its entry last, so one that fails, at a guard or in the
middle, leaves everything as it was, and runs again from the same start.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.operators.policies import require_empty

Tables = dict[str, DataFrame]


@dataclasses.dataclass(frozen=True)
class Migration:
    """``change`` maps the tables to those that it replaces or adds. Guards map the tables to rows that must not be there, before and after."""

    number: str
    change: Callable[[Tables], Tables]
    before: dict[str, Callable[[Tables], DataFrame]] = dataclasses.field(default_factory=dict)
    after: dict[str, Callable[[Tables], DataFrame]] = dataclasses.field(default_factory=dict)


class Ledger:
    """The applied migrations of a database folder and the tables as they are now."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        folder = self.path(f"{self.root}/_ledger")
        if not self.fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(r[0]) for n in names for r in self.spark.read.text(f"{self.root}/_ledger/{n}", wholetext=True).collect()]  # a line each

    def tables(self) -> Tables:
        done = self.entries()
        return {t: self.spark.read.parquet(f"{self.root}/{t}/v={v}") for t, v in (done[-1]["versions"] if done else {}).items()}

    def record(self, number: str, versions: dict[str, int]) -> None:
        """Adds the entry by renaming a finished file; the rename fails if another run was first."""
        at = f"{self.root}/_ledger/{len(self.entries()):06d}.json"
        draft = self.path(f"{self.root}/_ledger/_draft-{number}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": number, "versions": versions}).encode()))
        out.close()
        if self.fs.exists(self.path(at)) or not self.fs.rename(draft, self.path(at)):
            raise RuntimeError(f"{at} is there already")

    def apply(self, migration: Migration) -> bool:
        """Whether the migration was still to do; it is done then."""
        done = self.entries()
        if migration.number in [e["number"] for e in done]:
            return False
        if done and migration.number < done[-1]["number"]:
            raise ValueError(f"{migration.number} comes before {done[-1]['number']}, which is applied")
        now, versions = self.tables(), dict(done[-1]["versions"]) if done else {}
        for what, breach in migration.before.items():
            require_empty(breach(now), f"{migration.number}: {what}")
        for name, df in migration.change(now).items():
            versions[name] = len(done) + 1
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={versions[name]}")
        after = {t: self.spark.read.parquet(f"{self.root}/{t}/v={v}") for t, v in versions.items()}
        for what, breach in migration.after.items():
            require_empty(breach(after), f"{migration.number}: {what}")
        self.record(migration.number, versions)
        return True


def migrate(spark: SparkSession, root: str, migrations: list[Migration]) -> Tables:
    """Applies what the ledger lacks, in order of the numbers, and returns the tables."""
    ledger = Ledger(spark, root)
    for m in sorted(migrations, key=lambda m: m.number):
        ledger.apply(m)
    return ledger.tables()


def evolved(df: DataFrame, schema: str) -> DataFrame:
    """Rows of an older snapshot under a newer schema: columns that it lacks are null, types are cast, columns that are gone go."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def with_column(name: str, kind: str) -> Callable[[DataFrame], DataFrame]:
    """Adds a column of nulls if it is not there yet."""
    return lambda df: df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


# ---- markets. How a parcel number or a state tells the market.

TN_PARCEL = "^[0-9A-Za-z]{14}$"
TN, OH = ("shelby", "TN"), ("cuyahoga", "OH")
STATE_MARKETS = {"OH": "cuyahoga", "TN": "shelby"}


def parcel_markets(parcels: DataFrame, listings: DataFrame) -> DataFrame:
    """Parcels without a market get one: by their own marks (a native number, or one of 14 letters and digits), else the default; a parcel of the default market that only
    listings of the other state point to is theirs."""
    told = listings.filter("property_state in ('TN', 'OH')").groupBy("parcel_number").agg(F.count_if(F.col("property_state") == "TN").alias("_tn"), F.count_if(F.col("property_state") == "OH").alias("_oh"))
    known = F.col("market").isNotNull()
    marked = F.col("native_parcel_id").isNotNull() | F.col("parcel_number").rlike(TN_PARCEL)
    first = F.when(known, F.col("market")).when(marked, TN[0]).otherwise(OH[0])
    joined = parcels.withColumn("_first", first).join(told, "parcel_number", "left")
    moved = (F.col("_first") == OH[0]) & (F.coalesce("_tn", F.lit(0)) > 0) & (F.coalesce("_oh", F.lit(0)) == 0)
    state = F.when(moved, TN[1]).when(known, F.col("property_state")).when(marked, TN[1]).otherwise(OH[1])
    return joined.withColumns({"market": F.when(moved, TN[0]).otherwise(F.col("_first")), "property_state": state}).select(*parcels.columns)


def row_markets(rows: DataFrame, parcels: DataFrame, *, state: str | None = "property_state") -> DataFrame:
    """Rows without a market get that of their parcel (in their own state, if they have one), and otherwise that of their state. Of several markets the smallest is taken."""
    keys = ["parcel_number", *([state] if state else [])]
    one = parcels.filter("market is not null").groupBy(*keys).agg(F.min("market").alias("_market"))
    by_state = F.element_at(F.create_map(*[F.lit(x) for kv in STATE_MARKETS.items() for x in kv]), F.col(state)) if state else F.lit(None).cast("string")
    return rows.join(one, keys, "left").withColumn("market", F.coalesce("market", "_market", by_state)).select(*rows.columns)
