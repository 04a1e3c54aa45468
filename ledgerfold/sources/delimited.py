"""Landed delimited files: checked headers, odd separators, zipped tapes."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: list[str], *, sep: str = ",", fallback: str | None = None) -> DataFrame | None:
    """A CSV with header, all columns text, names trimmed and without byte-order mark; None if a required column is missing.

    With ``fallback``, that separator is tried if the first one finds fewer than two columns.
    """
    for s in [sep, *([fallback] if fallback else [])]:
        df = spark.read.csv(path, header=True, sep=s, multiLine=True, escape='"')
        df = df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])
        if len(df.columns) > 1 or s == fallback or not fallback:
            break
    return df if set(required) <= set(df.columns) else None


def read_zipped_tape(spark: SparkSession, path: str, columns: list[str], *, encoding: str = "latin-1", sep: str = ",") -> DataFrame:
    """CSV members of zip archives as rows of ``columns`` (text), with the archive's path and the line.

    Header names are trimmed and found in any case; a column that the tape lacks is null. Lines with more fields than the header are skipped. Undecodable bytes
    are replaced. Each archive is read by one task, streamed line by line; many archives spread over tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(archive.namelist()):
                        with archive.open(member) as f:
                            lines = csv.reader(io.TextIOWrapper(f, encoding=encoding, errors="replace", newline=""), delimiter=sep)
                            header = [h.strip().lower() for h in next(lines, [])]
                            at = [header.index(c.lower()) if c.lower() in header else None for c in columns]
                            block = []
                            for n, line in enumerate(lines, 2):
                                if not line or len(line) > len(header):
                                    continue
                                block.append([name, n, *[line[i].strip() if i is not None and i < len(line) else None for i in at]])
                                if len(block) == 10_000:
                                    yield pd.DataFrame(block, columns=["path", "line", *columns])
                                    block = []
                            if block:
                                yield pd.DataFrame(block, columns=["path", "line", *columns])

    return files.mapInPandas(rows, "path string, line int, " + ", ".join(f"`{c}` string" for c in columns))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in ``order``; rows without a key go."""
    rest = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def newest_file(listing: DataFrame, name: str = "name") -> DataFrame:
    """The file whose name carries the latest YYYYMMDD date."""
    day = F.to_date(F.nullif(F.regexp_extract(name, r"((?:19|20)[0-9]{6})", 1), F.lit("")), "yyyyMMdd")
    return listing.agg(F.max_by(name, F.struct(day, F.col(name))).alias(name), F.max(day).alias("day"))
