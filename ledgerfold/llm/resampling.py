"""Importance resampling towards a target distribution, with an exact distributed draw.

Texts become hashed features: runs of one to ``longest`` words, each in one of ``buckets`` buckets by its CRC-32. Two arrays of counts, of the
corpus and of the target texts, give each bucket a gain, the logarithm of how much likelier it is in the target; a document's weight is
the mean gain of its features, read from the array. Gumbel noise made from a hash of the seed and the id turns the weights into a draw without
replacement: the ``k`` highest scores are the sample.

The ``k``-th highest key (score, then smaller id) is found by radix selection: from the most significant digit down, Spark counts the
rows of each value of a digit among those that share the digits found so far. What reaches the driver is one histogram of at most 2^12 numbers a
digit. Only the rows up to that key are sorted by range and ranked; the others are never moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import append_columns, drop, fresh, store

BUCKETS = 10_000
LONGEST = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Bits of a digit of the radix selection; a histogram has two to that power numbers at most.
DIGIT = 12

WORD, BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a block at a time; no word is cut."""
    start = 0
    while start < len(text):
        end = BREAK.search(text, min(start + BLOCK, len(text)))
        stop = end.start() if end else len(text)
        yield WORD.findall(text[start:stop])
        start = stop


def text_buckets(text: bytes | None, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per block of a text in UTF-8: its number of words, and the buckets of the features that end in it."""
    # crcs[j] has, per word, the checksum of the run of j + 1 words that ends there; a run's checksum goes on from that of the run without its last word
    last: list[list[int]] = []
    for ws in _blocks((text or b"").translate(LOWER)):
        if not ws:
            continue
        crcs = [list(map(crc32, ws))]
        if longest > 1:
            spaced = [b" " + w for w in ws]
            for j in range(1, longest):
                before = (last[j - 1][-1:] if last else []) + crcs[j - 1][:-1]
                crcs.append(list(map(crc32, spaced[len(spaced) - len(before) :], before)))
        last = [(last[j] if last else [])[-1:] + c for j, c in enumerate(crcs)]
        yield len(ws), np.fromiter((x for c in crcs for x in c), np.uint32, sum(map(len, crcs))) % buckets


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): occurrences of features by bucket over all rows; buckets without any are left out. A task sends one array of counts at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                for _, found in text_buckets(value, buckets, longest):
                    counts += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts[hit])], ["bucket", "n"])

    return texts.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths and rounded down, from the counts of source and target; one array of ``buckets`` numbers."""
    spark = source.sparkSession
    kept = [store(x, "bucket-counts") for x in (source, target)]
    totals = [x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for x, _ in kept]
    s, t = (x.select("bucket", F.col("n").alias(name)) for (x, _), name in zip(kept, "st", strict=True))
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    ratio = (F.col("t") + 1.0) * F.lit(totals[0] + buckets) / ((F.col("s") + 1.0) * F.lit(totals[1] + buckets))
    out = np.zeros(buckets, np.int64)
    for bucket, gain in counts.select("bucket", F.floor(1000 * F.log(ratio))).toLocalIterator():  # as many rows as buckets
        out[bucket] = gain
    for _, path in kept:
        drop(spark, path)
    return out


def weigh(documents: DataFrame, gains: np.ndarray, *, text: str, longest: int, n_words: str, n_features: str, weight: str, keep_text: bool) -> DataFrame:
    """Adds the numbers of words and features and the mean gain, rounded down (0 without a word)."""

    def start():
        def work(texts: list[str | None]) -> list[list[int]]:
            rows = []
            for value in texts:
                words = features = total = 0
                for size, found in text_buckets((value or "").encode(), len(gains), longest):
                    words, features, total = words + size, features + len(found), total + int(gains[found].sum())
                rows.append((words, features, total // features if features else 0))
            return [[r[i] for r in rows] for i in range(3)]

        return work

    return append_columns(documents, [text], ", ".join(f"`{c}` bigint" for c in (n_words, n_features, weight)), start, omit=() if keep_text else (text,))


def gumbel(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from 32 bits of a SHA-256 of seed and id; a null id counts as the text ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def kth_key(rows: DataFrame, k: int, keys: list[Column]) -> list[int] | None:
    """The ``k``-th smallest of the keys (columns of type bigint, compared one after the other), by radix selection; None if there are fewer rows.

    Digits that all rows share are passed over, so a key takes as many counts as its range has digits.
    """
    sign, found = 1 << 63, []
    for i, key in enumerate(keys):
        low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if not 1 <= k <= n:
            return None
        low, high = low + sign, high + sign  # unsigned, in the same order
        shift = (max(1, (low ^ high).bit_length()) - 1) // DIGIT * DIGIT
        at = low >> shift + DIGIT
        while shift >= 0:
            digit = F.shiftrightunsigned(key.bitwiseXOR(F.lit(-sign)), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            for value, n in sorted(tuple(r) for r in rows.groupBy(digit.alias("d")).count().collect()):  # at most 2^DIGIT rows
                if k <= n:
                    break
                k -= n
            rows, at, shift = rows.filter(digit == value), at << DIGIT | value, shift - DIGIT
        found.append(at - sign)
        if n == 1 and i + 1 < len(keys):
            return found + list(rows.select(*keys[i + 1 :]).first())
    return found


def resample(
    documents: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
    seed: int = SEED, keep_text: bool = True, n_words: str = "n_words", n_features: str = "n_features", weight: str = "weight", score: str = "score", rank: str = "rank",
) -> DataFrame:
    """Every document with its numbers of words and features, weight, score and, if drawn, its rank (1 is the highest score); else a null rank.

    Of the documents with at least ``least_words`` words, ``percent`` per cent (rounded down) are drawn. Ties of the score go to the smaller id;
    rows without an id come last. Rows that share id and score are alike: as many of them are drawn as there is room for, and which ones is open. Null, empty and
    wordless texts have no features, weight 0 and are never drawn; texts of any length are read whole, in blocks. Without target texts all buckets have gains by
    the corpus alone. Ids are integers. Columns named like the results are replaced, other columns pass through. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    base = documents.drop(n_words, n_features, weight, score, rank)
    if dict(base.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} must be an integer column")
    gains = bucket_gains(bucket_counts(base, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), buckets)
    weighed = weigh(base, gains, text=text, longest=longest, n_words=n_words, n_features=n_features, weight=weight, keep_text=keep_text)
    scored, _ = store(weighed.withColumn(score, F.col(weight) + gumbel(seed, F.col(doc_id))), "scores")

    # smallest first: highest score, then ids before no id, then the smaller id
    keys = [-F.col(score), F.col(doc_id).isNull().cast("bigint"), F.coalesce(F.col(doc_id), F.lit(0)).cast("bigint")]
    may = F.col(n_words) >= least_words
    k = scored.filter(may).count() * percent // 100
    last = kth_key(scored.filter(may).select(score, doc_id), k, keys)
    if last is None:
        return scored.withColumn(rank, F.lit(None).cast("bigint"))
    upto = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys)]) <= F.struct(*[F.lit(x).cast("bigint").alias(f"k{i}") for i, x in enumerate(last)])
    drawn = F.coalesce(may & upto, F.lit(False))
    (at,) = fresh(scored, "at")
    order = [F.desc(score), F.asc_nulls_last(doc_id)]
    # the id that Spark gives a row is its partition and its place there, and partitions are ranges
    placed, _ = store(scored.filter(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "drawn")
    part, place, of, before = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1)), *fresh(placed, "of", "before")
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a partition
    starts = spark.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], f"`{of}` bigint, `{before}` bigint")
    ranked = placed.join(F.broadcast(starts), part == F.col(of)).withColumn(rank, F.col(before) + place + 1).withColumn(rank, F.when(F.col(rank) <= k, F.col(rank))).drop(at, of, before)
    return scored.filter(~drawn).withColumn(rank, F.lit(None).cast("bigint")).unionByName(ranked)
