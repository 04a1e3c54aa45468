"""A walk over numbered records as a stream whose offset is the frontier: the last number before the first long gap.

Records land in folders ``bin=<number // binSize>`` of Parquet files, each record under its number, whether it is in scope or not. Each trigger goes on from the
last offset until ``misses`` numbers in a row have no record, or ``maxIds`` numbers are walked. A record that is out of scope is not emitted but is a
record: it resets the count of misses. What lands in a gap before the frontier has moved past it is read; a walk that stopped at a gap tries it
again at the next trigger.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

MISSES, MAX_IDS, BIN = 25, 100_000, 1000


def frontier(ids: Iterator[int], start: int, misses: int) -> tuple[int, bool]:
    """The last of the ascending ids before the first gap of ``misses`` numbers, and whether there is that gap between two of them."""
    at = start
    for i in ids:
        if i - at > misses:
            return at, True
        at = max(at, i)
    return at, False


class _Walk(ds.DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.id = schema, options["path"], options.get("id", "id")
        self.start, self.misses, self.most, self.bin = int(options.get("start", 0)), int(options.get("misses", MISSES)), int(options.get("maxids", MAX_IDS)), int(options.get("binsize", BIN))
        self.scope, self.progress = json.loads(options.get("scope", "{}")), options["progress"]
        self.at = self._recall()

    def _recall(self) -> int:
        """Where the last planned batch ended; a walk goes on there after a restart."""
        where, path = fs.FileSystem.from_uri(self.progress)
        if where.get_file_info(path).type != fs.FileType.File:
            return self.start
        with where.open_input_stream(path) as f:
            return int(json.loads(f.read())["at"])

    def _remember(self, at: int) -> None:
        where, path = fs.FileSystem.from_uri(self.progress)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(path + ".new") as f:
            f.write(json.dumps({"at": at}).encode())
        where.move(path + ".new", path)

    def _files(self, number: int) -> list[str]:
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(f"{root}/bin={number}", allow_not_found=True))
        return [i.path for i in found if i.type == fs.FileType.File and re.search(r"/[^._][^/]*\.parquet$", i.path)]

    def _ids(self) -> Iterator[int]:
        """The numbers ahead that have a record, a bin at a time, at most ``maxIds`` of them; one bin's numbers are in memory."""
        where, _ = fs.FileSystem.from_uri(self.path)
        for number in range((self.at + 1) // self.bin, (self.at + self.most) // self.bin + 1):
            got: set[int] = set()
            for path in self._files(number):
                got.update(x for x in pq.read_table(path, columns=[self.id], filesystem=where).column(0).to_pylist() if x is not None)
            yield from (i for i in sorted(got) if self.at < i <= self.at + self.most)
            if not got and self.bin > self.misses:
                return

    def initialOffset(self) -> dict:
        return {"at": self.start}

    def latestOffset(self) -> dict:
        return {"at": frontier(self._ids(), self.at, self.misses)[0]}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        """A task a bin. The plan is kept first: a batch that is repeated after a failure ends where it was to end."""
        low, high = start["at"], end["at"]
        if high > self.at:
            self.at = high
            self._remember(high)
        if high <= low:
            return [ds.InputPartition((0, 0, 0))]
        return [ds.InputPartition((n, low, high)) for n in range((low + 1) // self.bin, high // self.bin + 1)]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        number, low, high = partition.value
        where, _ = fs.FileSystem.from_uri(self.path)
        columns = [f.name for f in self.schema]
        for path in self._files(number) if high > low else []:
            table = pq.read_table(path, columns=list(dict.fromkeys([*columns, self.id, *self.scope])), filesystem=where)
            keep = pc.and_(pc.greater(table[self.id], low), pc.less_equal(table[self.id], high))
            for column, value in self.scope.items():
                keep = pc.and_(keep, pc.equal(table[column], value))
            yield from table.filter(keep).select(columns).to_batches()


class IdWalk(ds.DataSource):
    """Options: ``path``; ``progress``, a file that says how far batches were planned, beside the checkpoint; ``id``, ``scope`` (JSON: column to value), ``start``, ``misses``, ``maxIds`` a trigger, ``binSize``."""

    @classmethod
    def name(cls) -> str:
        return "id_walk"

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:
        return _Walk(schema, {k.lower(): v for k, v in self.options.items()})


def walk_ids(
    spark: SparkSession, path: str, schema: str, progress: str, *, id: str = "id", scope: dict[str, object] | None = None, start: int = 0, misses: int = MISSES, max_ids: int = MAX_IDS, bin_size: int = BIN
) -> DataFrame:
    """A stream of the records in scope up to the frontier; see :class:`IdWalk`."""
    spark.dataSource.register(IdWalk)
    options = {"path": path, "progress": progress, "id": id, "scope": json.dumps(scope or {}), "start": str(start), "misses": str(misses), "maxIds": str(max_ids), "binSize": str(bin_size)}
    return spark.readStream.format("id_walk").schema(schema).options(**options).load()
