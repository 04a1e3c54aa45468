"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters that end a word: space and the five ASCII controls tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows of an intermediate table that share a file, where their number is known beforehand.
FILE_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, one machine (tests) uses its temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/ledgerfold-{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back.

    ``rows``: about how many it has at most. Its last stage then has a task, and so a file, for ``each`` of them instead of one for every
    shuffle partition. Files are dear: on a local file system each makes the executor start two processes that set modes.
    This cuts lineage, and the files outlive any executor. Returns the reread frame and its
    path; give the path to :func:`drop` once nothing reads the frame any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerfold/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // each)))).write.parquet(path)
    _kept[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder written by :func:`store`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _kept.pop(path, None)


#: Folders that results may still read; they go when the driver ends.
_kept: dict[str, SparkSession] = {}


@atexit.register
def _drop_rest() -> None:
    for path, spark in list(_kept.items()):
        with contextlib.suppress(Exception):  # the session may have been stopped
            drop(spark, path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def strip_blanks(c: Column) -> Column:
    """Without blanks at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    stripped = strip_blanks(F.coalesce(c, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, BLANK_CLASS + "+"))


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_bound(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def append_columns(df: DataFrame, inputs: list[str], schema: str, start: Callable, *, omit: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``omit``, with the columns of ``schema`` computed in Arrow batches from ``inputs``.

    ``start()`` runs once a task and returns a function from the input columns (lists of Python values)
    to the lists of the new columns. Columns of ``df`` named like new ones are replaced.
    """
    new = T.StructType.fromDDL(schema)
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in new} | {x.lower() for x in omit}]
    wide = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(inputs)])
    n, types = len(kept), [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            got = work(*[batch.column(n + i).to_pylist() for i in range(len(inputs))])
            columns = [*[batch.column(i) for i in range(n)], *[pa.array(x, t) for x, t in zip(got, types, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return wide.mapInArrow(run, T.StructType([*kept, *new.fields]))
