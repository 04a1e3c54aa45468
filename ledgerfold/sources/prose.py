"""Landed text: notices split into cases, and line-wise lists with headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def case_blocks(df: DataFrame, text: str, anchor: str) -> DataFrame:
    """One row for each block that begins at the anchor pattern, numbered from 0; text before the first is left out."""
    blocks = F.filter(F.split(F.col(text), f"(?={anchor})"), lambda b: b.rlike(f"^(?:{anchor})"))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(blocks).alias("block_no", "block"))


def notice_fields(block: Column) -> dict[str, Column]:
    """Fields of a legal notice: case number, parcel, date, amount."""
    first = lambda pattern: F.nullif(F.regexp_extract(block, pattern, 1), F.lit(""))
    return {
        "case_number": first(r"(?i)case\s+(?:no\.?|number)?\s*:?\s*([A-Z0-9-]+)"), "parcel": first(r"(?i)parcel\s*(?:no\.?|number|id)?\s*:?\s*([0-9][0-9-]{5,})"),
        "sale_date": F.try_to_date(first(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"), "M/d/yyyy"), "amount": F.regexp_replace(first(r"\$\s*([0-9][0-9,]*\.?[0-9]*)"), ",", "").try_cast("decimal(18,2)"),
    }


def list_state_machine(lines: DataFrame, document: str, order: str, text: str, *, header: str, start: str) -> DataFrame:
    """Line lists with section headers and records: a record begins at ``start`` and has all lines up to the next; it carries the last header.

    Returns document, record (from 1), header and the record's lines joined by newlines. Documents are independent of
    each other; one document's lines are in one task.
    """
    upto = W.partitionBy(document).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    is_header, is_start = F.col(text).rlike(header), F.col(text).rlike(start)
    marked = lines.withColumn("section", F.last(F.when(is_header, F.col(text)), ignorenulls=True).over(upto)).withColumn("record", F.sum(is_start.cast("int")).over(upto))
    inside = marked.filter(~is_header & (F.col("record") > 0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return inside.groupBy(document, "record").agg(F.min_by("section", order).alias("header"), body.alias("body"))


def calendar_days(c: Column, as_of: Column) -> Column:
    """Dates (M/D/YYYY) in a text that are not past, in order, each once."""
    days = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"), F.lit(1)), lambda d: F.try_to_date(d, "M/d/yyyy"))
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull() & (d >= as_of))))
