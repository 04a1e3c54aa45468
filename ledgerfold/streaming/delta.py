"""Streaming ingest: deltas with overlap are merged into versioned snapshots; a bookmark says how far a source was read."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators.merging import collapse, upsert


def versions(spark: SparkSession, table: str) -> list[int]:
    """Committed versions of a snapshot table, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    return sorted(done)


def read_snapshot(spark: SparkSession, table: str, schema) -> DataFrame:
    """The latest version; an empty table before the first."""
    done = versions(spark, table)
    return spark.read.schema(schema).parquet(f"{table}/v={done[-1]}") if done else spark.createDataFrame([], schema)


def merge_batch(table: str, keys: list[str], seq: str, schema, keep_versions: int = 3) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges a batch into the next version. Version numbers are batch ids, so a batch that is delivered again
    after a failure writes the same version again from the one before it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, table) if v < batch_id + 1]
        current = spark.read.schema(schema).parquet(f"{table}/v={before[-1]}") if before else spark.createDataFrame([], schema)
        changes = collapse(batch, keys, seq)
        upsert(current, changes, keys).drop("is_new").write.mode("overwrite").parquet(f"{table}/v={batch_id + 1}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for v in before[: -keep_versions + 1]:
            old = hadoop(f"{table}/v={v}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return run


def stream_merge(source: DataFrame, table: str, checkpoint: str, *, keys: list[str], seq: str, schema):
    """All data that is there now, merged; start again to go on where it stopped. Re-delivered rows change nothing, as merging is by key."""
    return source.writeStream.foreachBatch(merge_batch(table, keys, seq, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delta(rows: DataFrame, updated: str, last_success, overlap_days: int = 1) -> DataFrame:
    """Rows updated since the last success, less an overlap; what comes twice is absorbed by the merge."""
    return rows.filter(F.col(updated) >= F.lit(last_success) - F.make_dt_interval(F.lit(overlap_days)))


def advance_cursor(found: DataFrame, cursor: int, misses: int = 25) -> tuple[int, bool]:
    """How far ids (column id) were read without a gap of ``misses`` or more, and whether that gap, the frontier, was reached.

    Ids fall into bins of ``misses``, of which only the least and the greatest id count, so the order is found over few rows; the first gap is one
    aggregation over them.
    """
    ahead = found.select("id").filter(F.col("id") > cursor)
    bins = ahead.groupBy(F.floor(F.col("id") / misses).alias("bin")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    # the bin before, if it is the neighbour or the one before that; otherwise there is a gap of more than ``misses``
    near = bins.select("bin", "high").withColumn("bin", F.explode(F.array(F.col("bin") + 1, F.col("bin") + 2))).groupBy("bin").agg(F.max("high").alias("before"))
    gaps = bins.join(near, "bin", "left").filter((F.col("low") - cursor > misses) & (F.col("before").isNull() | (F.col("low") - F.col("before") > misses)))
    frontier = gaps.agg(F.min("low")).first()[0]
    at = ahead.filter(F.col("id") < frontier if frontier is not None else F.lit(True)).agg(F.max("id")).first()[0]
    return (cursor if at is None else at), frontier is not None


def window_cursor(windows: DataFrame, cursor: datetime.date | None = None) -> datetime.date | None:
    """How far a walk over date windows (start, end, ok) got: the end of the last window before the first that failed. Two aggregations, no order."""
    failed = windows.filter(~F.coalesce("ok", F.lit(False))).agg(F.min("start")).first()[0]
    done = windows.filter(F.col("start") < F.lit(failed)) if failed is not None else windows
    end = done.agg(F.max("end")).first()[0]
    return max(x for x in (cursor, end) if x is not None) if cursor or end else None


def write_cursor(cursors: DataFrame, source: str, value: object) -> DataFrame:
    """The cursor table (source_site, value as text) with the source's cursor set."""
    new = cursors.sparkSession.createDataFrame([(source, str(value))], "source_site string, value string")
    return upsert(cursors.select("source_site", "value"), new, ["source_site"]).drop("is_new")


def windowed_counts(stream: DataFrame, when: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """An extension: counts by event-time window and type, with late data up to the watermark."""
    return stream.withWatermark(when, late).groupBy(F.window(when, size), "event_type").agg(F.count("*").alias("n"))
