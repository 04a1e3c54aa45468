"""Landed workbooks and MessagePack streams, one file at a time inside the tasks."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of a workbook's first sheet by position, as text; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{_NS['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = 0
                for x in letters[0] if letters else "":
                    at = at * 26 + ord(x) - 64
                cells += [None] * (max(at, len(cells) + 1) - 1 - len(cells))
                value = c.findtext("m:v", None, _NS)
                inline = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else inline if c.get("t") == "inlineStr" else value)
            yield cells


def read_workbooks(spark: SparkSession, path: str, columns: list[str], skip: int = 1) -> DataFrame:
    """The first ``columns`` cells of each row after ``skip`` header rows, as text, with path and row number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [[name, n, *(cells + [None] * len(columns))[: len(columns)]] for n, cells in enumerate(sheet_rows(content), 1) if n > skip]
                yield pd.DataFrame(rows, columns=["path", "row", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, " + ", ".join(f"`{c}` string" for c in columns))


def unpack(data: bytes) -> Iterator[object]:
    """The objects of a MessagePack stream, one after the other."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the stream ends inside an object")
        at += n
        return data[at - n : at]

    def number(fmt: str):
        return struct.unpack(fmt, take(struct.calcsize(fmt)))[0]

    def one():
        b = take(1)[0]
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return {one(): one() for _ in range(b & 15)}
        if b < 0xA0:
            return [one() for _ in range(b & 15)]
        if b < 0xC0:
            return take(b & 31).decode("utf-8", "replace")
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b in (0xC4, 0xC5, 0xC6):
            return take(number((">B", ">H", ">I")[b - 0xC4]))
        if 0xCA <= b <= 0xD3:
            return number((">f", ">d", ">B", ">H", ">I", ">Q", ">b", ">h", ">i", ">q")[b - 0xCA])
        if b in (0xD9, 0xDA, 0xDB):
            return take(number((">B", ">H", ">I")[b - 0xD9])).decode("utf-8", "replace")
        if b in (0xDC, 0xDD):
            return [one() for _ in range(number((">H", ">I")[b - 0xDC]))]
        if b in (0xDE, 0xDF):
            return {one(): one() for _ in range(number((">H", ">I")[b - 0xDE]))}
        raise ValueError(f"unknown type {b:#x}")

    while at < len(data):
        yield one()


def read_positional_stream(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Records of MessagePack files that are arrays by position; a shorter record keeps the rest of the one before (delta records), null fields too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                last: list = [None] * len(columns)
                rows = []
                for n, record in enumerate(x for x in unpack(content) if isinstance(x, list)):
                    last = [record[i] if i < len(record) and record[i] is not None else last[i] for i in range(len(columns))]
                    rows.append([name, n, *[None if v is None else str(v) for v in last]])
                yield pd.DataFrame(rows, columns=["path", "record", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, record int, " + ", ".join(f"`{c}` string" for c in columns))
