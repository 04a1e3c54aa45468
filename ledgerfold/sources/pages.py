"""Landed JSON pages and HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_pages(spark: SparkSession, path: str, schema: str, rows: str = "rows") -> DataFrame:
    """Rows of landed page files, each one object with an array ``rows``; all pages are read, none ends the scan early."""
    page = T.StructType([T.StructField(rows, T.ArrayType(T.StructType.fromDDL(schema)))])
    return spark.read.schema(page).json(path, multiLine=True).select(F.explode(rows).alias("r")).select("r.*")


def scan_complete(spark: SparkSession, path: str, rows: str = "rows", total: str = "total") -> DataFrame:
    """Rows that came against the total that the pages announce."""
    pages = spark.read.json(path, multiLine=True)
    return pages.agg(F.sum(F.size(rows)).alias("got"), F.max(total).alias("announced")).withColumn("complete", F.col("got") >= F.col("announced"))


def nested_json(c: Column, schema: str) -> Column:
    """JSON that holds JSON as text."""
    return F.from_json(F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")).otherwise(c), schema)


def template_fields(blob: Column) -> Column:
    """Records of a token template (@A between records, @G between fields, each 'label:value') as an array of maps.

    A field without a label continues an address: it is kept as ``__city_zip__``.
    """
    labelled = lambda f: F.regexp_extract(f, r"(?s)^([^:]*):", 1)
    field = lambda f: F.when(f.contains(":"), F.struct(F.btrim(labelled(f)).alias("k"), F.btrim(F.regexp_extract(f, r"(?s)^[^:]*:(.*)$", 1)).alias("v"))).otherwise(F.struct(F.lit("__city_zip__").alias("k"), F.btrim(f).alias("v")))
    fields = lambda r: F.transform(F.filter(F.split(r, "@G"), lambda f: F.btrim(f) != ""), field)
    unique = lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return F.transform(F.filter(F.split(blob, "@A"), lambda r: F.btrim(r) != ""), lambda r: F.map_from_entries(unique(fields(r))))


def strip_tags(c: Column) -> Column:
    """Text of simple markup: tags to spaces, the common references decoded, white space single."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(pages: DataFrame, html: str, columns: list[str], key: str) -> DataFrame:
    """Rows of the HTML tables whose header has all ``columns`` (in any order and case); one Arrow batch at a time."""
    wanted = [c.lower() for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html], strict=True):
                parser, at = _Tables(), None
                parser.feed(text or "")
                for n, row in enumerate(parser.rows):
                    low = [x.lower() for x in row]
                    if set(wanted) <= set(low):
                        at = [low.index(c) for c in wanted]
                    elif at and len(row) > max(at):
                        out.append([k, n, *[row[i] for i in at]])
            yield pd.DataFrame(out, columns=[key, "row", *columns])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, row int, " + ", ".join(f"`{c}` string" for c in columns))


def grid_cells(html: Column, fields: list[str]) -> Column:
    """Grids whose cells are spans with ids ending in ``field_row``: an array of maps, one a row, in row order."""
    cell = r'(?is)<span[^>]*\bid="[^"]*?({})_([0-9]+)"[^>]*>(.*?)</span>'.format("|".join(fields))
    part = lambda n: F.regexp_extract_all(html, F.lit(cell), F.lit(n))
    cells = F.transform(F.arrays_zip(part(1).alias("field"), part(2).alias("row"), part(3).alias("value")), lambda x: F.struct(x["row"].cast("int").alias("row"), x["field"].alias("field"), strip_tags(x["value"]).alias("value")))
    rows = F.array_sort(F.array_distinct(F.transform(cells, lambda x: x["row"])))
    first = lambda r, f: F.get(F.filter(cells, lambda x: (x["row"] == r) & (x["field"] == f)), F.lit(0))["value"]
    return F.transform(rows, lambda r: F.struct(r.alias("row"), *[first(r, f).alias(f) for f in fields]))


def list_records(html: Column, size: int) -> Column:
    """Hit lists with ``size`` list items a record: an array of arrays of text; an unfinished last record goes."""
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), strip_tags)
    whole = F.floor(F.size(items) / size).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda k: F.slice(items, k * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))
