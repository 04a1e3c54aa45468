"""Landed page scans as a Spark data source: numbered JSON pages of one query against a paginated service.

``spark.read.format("landed_pages")`` reads a folder of pages, a task for each group of them. Filters that Spark pushes down are applied to a page before any of
its rows leave the reader. A scan is complete or fails: a page that holds an error body, a page that is short though others follow, a
missing page and a count that disagrees with the announced total are errors, never fewer rows. A task that fails is retried by Spark as usual.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Comparisons that a page is filtered by; all others are left to Spark.
COMPARE = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}
TEXT = {ds.StringStartsWith: pc.starts_with, ds.StringEndsWith: pc.ends_with, ds.StringContains: pc.match_substring}


class IncompleteScan(Exception):
    """The landed pages are not all of the answer."""


def _within(value: object, path: str) -> object:
    """The value at a dotted path; None where there is none."""
    for key in filter(None, path.split(".")):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _list_pages(where: fs.FileSystem, root: str) -> tuple[list[tuple[int, str]], list[str]]:
    """Pages by number, the last one in a file's name or, for part files, in its folder's name; and the files whose name, or folder's name, begins with ``count``."""
    pages, counts = [], []
    for info in where.get_file_info(fs.FileSelector(root, recursive=True)):
        inside = info.path[len(root) :].strip("/")
        if info.type != fs.FileType.File or re.search(r"(^|/)[._]", inside):
            continue
        named = re.sub(r"/part-[^/]*$", "", inside)
        if named.rsplit("/", 1)[-1].startswith("count"):
            counts.append(info.path)
        elif numbers := re.findall(r"[0-9]+", named):
            pages.append((int(numbers[-1]), info.path))
    return sorted(pages), sorted(counts)


def _typed(value: object, kind: T.DataType) -> object:
    """A JSON value as the column's type; numbers may come as text and text as numbers, as services do."""
    if value is None or value == "" and not isinstance(kind, T.StringType):
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(str(value)[:10])
    if isinstance(kind, T.IntegralType):
        return int(value)
    return float(value) if isinstance(kind, T.FractionalType) else value


class _Reader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.filters = schema, []
        self.path, self.rows, self.item = options["path"], options.get("rows", "features"), options.get("item", "")
        self.total, self.size, self.group = options.get("total", "count"), int(options["pagesize"]), int(options.get("pagespertask", 16))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        names = {f.name for f in self.schema}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in names and (type(f) in COMPARE or type(f) in TEXT or isinstance(f, (ds.In, ds.IsNull, ds.IsNotNull))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        """Groups of pages. The count page, or else the first page, announces the total, which fixes how many pages there are and how long each is."""
        where, root = fs.FileSystem.from_uri(self.path)
        pages, counts = _list_pages(where, root)
        source = counts[0] if counts else pages[0][1] if pages else None
        announced = _within(self._load(where, source), self.total) if source else None
        if announced is None:
            raise IncompleteScan(f"{self.path}: no page announces {self.total}")
        wanted = -(-int(announced) // self.size)
        if len(pages) < wanted or len({n for n, _ in pages}) < len(pages):
            raise IncompleteScan(f"{self.path}: {len(pages)} pages of {self.size} for {announced} rows")
        lengths = [min(self.size, int(announced) - i * self.size) for i in range(len(pages))]
        work = [(path, max(0, n)) for (_, path), n in zip(pages, lengths, strict=True)]
        return [ds.InputPartition(work[i : i + self.group]) for i in range(0, max(1, len(work)), self.group)]

    @staticmethod
    def _load(where: fs.FileSystem, path: str) -> object:
        with where.open_input_stream(path) as f:
            page = json.loads(f.read())
        if isinstance(page, dict) and page.get("error"):  # services answer errors with a page
            raise IncompleteScan(f"{path}: {page['error']}")
        return page

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.schema)
        for path, wanted in partition.value:
            page = self._load(where, path)
            rows = _within(page, self.rows) if self.rows else page
            if not isinstance(rows, list) or len(rows) != wanted:
                raise IncompleteScan(f"{path}: {len(rows) if isinstance(rows, list) else 'no'} rows, not {wanted}")
            items = [_within(r, self.item) or {} for r in rows]
            batch = pa.RecordBatch.from_pydict({f.name: [_typed(r.get(f.name), f.dataType) for r in items] for f in self.schema}, schema=schema)
            for f in self.filters:
                batch = batch.filter(self._holds(batch, f))
            yield batch

    @staticmethod
    def _holds(batch: pa.RecordBatch, f: ds.Filter) -> pa.Array:
        column = batch.column(f.attribute[0])
        if isinstance(f, ds.IsNull):
            return pc.is_null(column)
        if isinstance(f, ds.IsNotNull):
            return pc.is_valid(column)
        if isinstance(f, ds.In):
            return pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
        return TEXT[type(f)](column, f.value) if type(f) in TEXT else COMPARE[type(f)](column, pa.scalar(f.value, column.type))


class LandedPages(ds.DataSource):
    """Options: ``path``; ``pageSize``; ``rows``, the dotted path of a page's array (default ``features``); ``item``, that of the record within an
    element; ``total``, that of the announced total (default ``count``), in the file or folder whose name begins with ``count`` or else in the first page;
    ``pagesPerTask``. The schema is the list of columns that are taken."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})


def read_landed_pages(spark: SparkSession, path: str, schema: str, page_size: int, *, rows: str = "features", item: str = "", total: str = "count", pages_per_task: int = 16) -> DataFrame:
    """A complete scan of landed pages, with filters pushed into it; see :class:`LandedPages`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    options = {"path": path, "pageSize": str(page_size), "rows": rows, "item": item, "total": total, "pagesPerTask": str(pages_per_task)}
    return spark.read.format("landed_pages").schema(schema).options(**options).load()
