"""Line dedup: drop lines that many documents share, all but one copy.

A sharded minimal perfect hash (MPH) holds the repeated lines. Each line key has a 128-bit hash, two
64-bit halves. Pass one counts, per hash, the documents that hold it and the largest of their ids;
hashes that ``indexed_from`` documents do not hold are left out of the index to keep it small. The rest are dealt to shards; each shard becomes
one MPH (bit arrays in levels; a key's slot is the rank of its bit) over three flat arrays: a 64-bit
fingerprint, a count, and the document that keeps the line. Pass two reads the documents again and
probes the arrays: a line goes if its fingerprint is that of its slot, the count there is ``min_docs`` or more, and another document keeps it. No line
is joined, and an unknown line fails at its fingerprint: a wrong drop takes a 128-bit collision.

Where the arrays live. Their size is known before pass two (``ENTRY_BYTES`` an entry). Up to ``broadcast_bytes`` the shards
are broadcast and the documents stay where they are. Beyond, documents send the hashes of their
lines, not the lines, to tasks that each hold one shard; a shard is dealt over as many salts as its own lines take (repeated lines are counted by shard, so a line
that a third of all documents hold is split), and the dropped lines come back by document id.
Both ways give the same rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.llm.common import BLANKS, fresh, store

MIN_CHARS, MIN_DOCS = 40, 5
ENTRY_BYTES = 24
BROADCAST_BYTES = 64 << 20
SHARD_ENTRIES = 1 << 18
TASK_LINES = 1 << 19
NULL_ID = -(2**63)
_BLANK_BYTES = BLANKS.encode()
_U64 = np.uint64


def line_key(line: str) -> bytes:
    """Blanks stripped at both ends and A-Z lower-cased, as UTF-8."""
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def _keys(text: str | None, min_chars: int) -> tuple[list[str], list[int], np.ndarray]:
    """The lines, which of them have a key that is long enough, and these keys' hashes (n x 2)."""
    lines = (text or "").split("\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(line.strip(BLANKS)) >= min_chars:
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(line_key(line)))
    return lines, at, np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


# ---- the minimal perfect hash


def _level_bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """One bit position a key in a level of ``size`` bits; both halves of the hash count."""
    x = (h[:, 0] ^ (h[:, 1] * _U64(0x9E3779B97F4A7C15))) + _U64((level * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U64(32))) % _U64(size)


def build_mph(h: np.ndarray) -> list[np.ndarray]:
    """Levels of bits: a key has the bit of the first level in which nobody else hashes to it."""
    levels, left = [], h
    while len(left):
        bits = _level_bit(left, len(levels), size := 2 * len(left) + 1)
        alone = np.bincount(bits.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        left = left[~alone[bits]]
        if len(levels) > 200:
            raise ValueError("equal keys")
    return levels


class Shard:
    """An MPH over ``n`` keys and the arrays that its slots index."""

    def __init__(self, levels: list[np.ndarray], fingerprint: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.levels, self.fingerprint, self.count, self.keeper = levels, fingerprint, count, keeper
        self.offsets, at = [], 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64) - bits
            self.offsets.append(rank + at)
            at += int(bits.sum())

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that no level knows."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            bit = _level_bit(h[left], level, len(bits)).astype(np.int64)
            hit = bits[bit]
            out[left[hit]] = self.offsets[level][bit[hit]]
            left = left[~hit]
        return out

    def probe(self, h: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether the shard has it with at least ``min_docs`` documents, and its keeper."""
        slot = self.slots(h)
        known = slot >= 0
        known[known] = (self.fingerprint[slot[known]] == h[known, 1]) & (self.count[slot[known]] >= min_docs)
        keeper = np.zeros(len(h), np.int64)
        keeper[known] = self.keeper[slot[known]]
        return known, keeper

    @classmethod
    def build(cls, h: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> Shard:
        out = cls(build_mph(h), np.zeros(len(h), _U64), np.zeros(len(h), np.uint32), np.zeros(len(h), np.int64))
        slot = out.slots(h)
        out.fingerprint[slot], out.count[slot], out.keeper[slot] = h[:, 1], np.minimum(count, 2**32 - 1), keeper
        return out

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, sizes=np.array([len(x) for x in self.levels]), bits=np.packbits(np.concatenate(self.levels)) if self.levels else np.zeros(0, np.uint8), fingerprint=self.fingerprint, count=self.count, keeper=self.keeper)
        return file.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        x = np.load(io.BytesIO(blob))
        bits = np.unpackbits(x["bits"]).astype(bool)
        ends = np.cumsum(x["sizes"])
        return cls([bits[e - n : e] for n, e in zip(x["sizes"], ends, strict=True)], x["fingerprint"], x["count"], x["keeper"])


# ---- the passes


def _emit(min_chars: int):
    """Pass one: the distinct keys of each document, pre-aggregated over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, h = _keys(text.as_py(), min_chars)
                if len(h):
                    hashes.append(h := np.unique(h, axis=0) if len(h) > 1 else h)
                    ids.append(np.full(len(h), NULL_ID if doc_id is None else doc_id))
            if hashes:
                f = pd.DataFrame(np.concatenate(hashes).view("<i8"), columns=["h1", "h2"])
                f["keeper"] = np.concatenate(ids)
                f = f.groupby(["h1", "h2"], sort=False)["keeper"].agg(["size", "max"]).reset_index()
                yield pa.RecordBatch.from_arrays([pa.array(f["h1"]), pa.array(f["h2"]), pa.array(f["size"], pa.int64()), pa.array(f["max"], pa.int64())], ["h1", "h2", "n", "keeper"])

    return run


def repeated_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, seen: Observation | None = None) -> DataFrame:
    """h1, h2, n (documents that hold the line), keeper (the largest id among them). ``seen`` counts all long lines."""
    emitted = documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_emit(min_chars), "h1 long, h2 long, n long, keeper long")
    counts = emitted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    if seen is not None:
        counts = counts.observe(seen, F.sum("n").alias("lines"))
    return counts.filter(F.col("n") >= min_docs)


def _build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    h = np.ascontiguousarray(group[["h1", "h2"]].to_numpy()).view(_U64)
    return pd.DataFrame({"shard": [key[0]], "lines": [group["n"].sum()], "blob": [Shard.build(h, group["n"].to_numpy(), group["keeper"].to_numpy()).dump()]})


def _drops(doc_id: int | None, h: np.ndarray, shards: dict[int, Shard], n: int, min_docs: int) -> np.ndarray:
    """Which keys the document loses."""
    gone, shard = np.zeros(len(h), bool), np.mod(h[:, 0].view("<i8"), n)
    for s in np.unique(shard):
        if (held := shards.get(int(s))) is not None:
            at = np.flatnonzero(shard == s)
            known, keeper = held.probe(h[at], min_docs)
            gone[at] = known & (keeper != (NULL_ID if doc_id is None else doc_id))
    return gone


def _rewrite(batch: pa.RecordBatch, at: int, texts: list[str], n_lines: list[int], n_dropped: list[int], width: int) -> pa.RecordBatch:
    """The first ``width`` columns with the texts replaced, and the two counts."""
    columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(width)]
    columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def _probe_here(base: DataFrame, blobs: dict[int, bytes], shards: int, at_id: int, at_text: int, min_chars: int, min_docs: int, counts: tuple[str, str]) -> DataFrame:
    """Documents stay where they are; the shards are broadcast (their size was checked)."""
    held, width = base.sparkSession.sparkContext.broadcast(blobs), len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {k: Shard.load(v) for k, v in held.value.items()}
        for batch in batches:
            texts, totals, dropped = [], [], []
            for doc_id, text in zip(batch.column(at_id).to_pylist(), batch.column(at_text), strict=True):
                lines, at, h = _keys(text.as_py(), min_chars)
                gone = {at[i] for i in np.flatnonzero(_drops(doc_id, h, loaded, shards, min_docs))} if at else ()
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
                totals.append(len(lines))
                dropped.append(len(gone))
            yield _rewrite(batch, at_text, texts, totals, dropped, width)

    return _map(base, base, run, counts)


def _probe_there(base: DataFrame, index: DataFrame, salts: np.ndarray, at_id: int, at_text: int, min_chars: int, min_docs: int, counts: tuple[str, str]) -> DataFrame:
    """Hashes of lines go to the tasks that hold the shards (``salts`` copies of each); the hashes to drop come back by document id."""
    width, (id_, gone) = len(base.columns), fresh(base, "of", "gone")
    ids, texts = base.columns[at_id], base.columns[at_text]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, at, h = _keys(text.as_py(), min_chars)
                if at:
                    h = np.unique(h, axis=0)
                    shard = np.mod(h[:, 0].view("<i8"), len(salts))
                    salt = np.mod(np.int64(xxhash.xxh32_intdigest(str(doc_id))), salts[shard])
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(salt.astype(np.int32)), pa.array([doc_id] * len(h), pa.int64()), pa.array(h[:, 0].view("<i8")), pa.array(h[:, 1].view("<i8"))], ["shard", "salt", "doc", "h1", "h2"])

    def probe(key: tuple, lines: pd.DataFrame, blob: pd.DataFrame) -> pd.DataFrame:
        if not len(blob) or not len(lines):
            return lines.iloc[:0][["doc", "h1", "h2"]]
        h = np.ascontiguousarray(lines[["h1", "h2"]].to_numpy()).view(_U64)
        known, keeper = Shard.load(blob["blob"][0]).probe(h, min_docs)
        return lines[known & (lines["doc"].isna().to_numpy() | (keeper != lines["doc"].fillna(NULL_ID).to_numpy().astype(np.int64))) & ~(lines["doc"].isna().to_numpy() & (keeper == NULL_ID))][["doc", "h1", "h2"]]

    salted = base.select(F.col(ids).cast("long"), F.col(texts)).mapInArrow(hashes, "shard long, salt int, doc long, h1 long, h2 long")
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "blob")
    lost = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "doc long, h1 long, h2 long")
    lost = lost.groupBy(F.col("doc").alias(id_)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    joined = base.join(lost, base[ids].cast("long").eqNullSafe(lost[id_]), "left").drop(id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for text, lost in zip(batch.column(at_text), batch.column(width).to_pylist(), strict=True):
                lines, at, h = _keys(text.as_py(), min_chars)
                bad = {(x["h1"], x["h2"]) for x in lost or ()}
                gone = {i for i, x in zip(at, h.view("<i8").tolist(), strict=True) if tuple(x) in bad} if bad else ()
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
                totals.append(len(lines))
                dropped.append(len(gone))
            yield _rewrite(batch, at_text, texts, totals, dropped, width)

    return _map(joined, base, run, counts)


def _map(df: DataFrame, base: DataFrame, run, counts: tuple[str, str]) -> DataFrame:
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return df.mapInArrow(run, schema)


def dedup_lines(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES, shard_entries: int = SHARD_ENTRIES, task_lines: int = TASK_LINES, indexed_from: int | None = None, n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``documents`` with repeated lines dropped from ``text``, and two counts.

    Lines are the parts between newlines; a null or empty text is one empty line and comes out as ''. A line's key is the
    line without blanks (space, tab to carriage return) at both ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose all lines except those of the document with the
    largest id that holds the key. The other lines stay as they are, joined by newlines. ``n_lines`` counts before dropping.

    Rows that share an id count as separate documents; all of them that hold a key and have its largest id keep it. A null id is
    below every other. ``indexed_from`` (by default ``min_docs``) is how many documents a line needs to be in the index at all; the result does not
    hang on it. Other columns pass through; columns named ``n_lines`` and ``n_dropped`` are replaced. An
    empty table gives an empty result.
    """
    spark, base = documents.sparkSession, documents.drop(n_lines, n_dropped)
    at_id, at_text = base.columns.index(doc_id), base.columns.index(text)
    seen = Observation(f"lines-{uuid.uuid4().hex}")
    repeated, _ = store(repeated_lines(documents, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min(min_docs, indexed_from or min_docs), seen=seen), "repeated-lines")
    entries, lines = repeated.count(), seen.get["lines"] or 0
    shards = max(1, -(-entries // shard_entries))
    index = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long")).groupBy("shard").applyInPandas(_build, "shard long, lines long, blob binary")
    if entries * ENTRY_BYTES <= broadcast_bytes:
        return _probe_here(base, {r["shard"]: bytes(r["blob"]) for r in index.toLocalIterator()}, shards, at_id, at_text, min_chars, min_docs, (n_lines, n_dropped))
    index, _ = store(index, "line-index")
    # One number a shard. Lines outside the index spread evenly.
    loads = np.zeros(shards)
    for r in index.select("shard", "lines").toLocalIterator():
        loads[r["shard"]] = r["lines"]
    salts = np.maximum(1, np.ceil((loads + max(0.0, lines - loads.sum()) / shards) / task_lines)).astype(np.int64)
    index = index.join(spark.createDataFrame(pd.DataFrame({"shard": np.arange(shards), "salts": salts.astype(np.int32)})), "shard")
    return _probe_there(base, index, salts, at_id, at_text, min_chars, min_docs, (n_lines, n_dropped))
