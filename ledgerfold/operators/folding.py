"""Per-key reductions of landed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_sales(sales: DataFrame) -> DataFrame:
    """The newest sale of each parcel; of equal dates the highest price."""
    best = sales.groupBy("parcel_number").agg(F.max(F.struct("sale_date", "price")).alias("s"))
    return best.select("parcel_number", F.col("s.sale_date").alias("last_sale_date"), F.col("s.price").alias("last_sale_price"))


def fold_parcels(records: DataFrame, key: str, amount: str, kind: str, when: str) -> DataFrame:
    """Per key: sum, sorted distinct kinds, first and last day."""
    return records.groupBy(key).agg(F.sum(amount).alias("total"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.to_date(F.min(when)).alias("first_day"), F.to_date(F.max(when)).alias("last_day"))


def distinct_over(records: DataFrame, key: str, value: str, cap: int) -> DataFrame:
    """Keys with more than ``cap`` different values."""
    return records.groupBy(key).agg(F.count_distinct(value).alias("n")).filter(F.col("n") > cap)


def duplicates(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys with several rows, their number and their ids in order."""
    grouped = records.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, "id"))).alias("rows"))
    return grouped.filter("n > 1").select(*keys, "n", F.array_join(F.transform("rows", lambda x: x["id"]), ",").alias("ids"))


def upper_median(records: DataFrame, key: str, value: str) -> DataFrame:
    """The element at half the length of the sorted values (not interpolated): counts of distinct values are aggregated, no key's rows are collected."""
    return records.groupBy(key).agg(upper_middle(value).cast(dict(records.dtypes)[value]).alias("median"))


def upper_middle(value: str, condition: str = "true") -> Column:
    """The aggregate behind :func:`upper_median`: the lower median of the negated values, negated; of the rows that meet the condition."""
    return F.expr(f"-percentile_disc(0.5) within group (order by -`{value}`) filter (where {condition})")
