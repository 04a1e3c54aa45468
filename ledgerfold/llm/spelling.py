"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of L letters is cut into two even segments, and each segment into two even parts. One inserted, deleted or replaced letter leaves one of the two
segments untouched, and one part of the other. So each word is indexed under four keys: its length, one segment, and one part of the other
segment, which splits the buckets of frequent segments. A word probes with the same pieces cut at the places where a word of its own length has them,
and at those where they lie in a word that is one letter shorter: pieces behind the extra letter are shifted by one. Any two words
one edit apart share a key. Within a bucket only a quarter of the word is open, so buckets stay small however many words there are.
Candidates are verified by edit distance, and those that meet in several buckets are made one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import drop, lower_ascii, store

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 7
OCCURRENCES = 2
RATIO = 10
EVERY = 31


def word_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``letters`` letters that occur ``occurrences`` times or more.

    One in ``every`` occurrences, chosen by a checksum of id and word, loses a letter (0: none does); a null id counts as the text ''.
    """
    run = F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(RUN), F.lit(0)))
    runs = documents.select(F.col(doc_id).alias("id"), run.alias("word")).filter(F.length("word") >= letters)
    if every:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def keys(word: Column, longer: int) -> Column:
    """The four keys of a word; with ``longer`` 1, those of the words one letter shorter of which it may be a lengthened form."""
    size = F.length(word) - longer
    half = F.floor(size / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), (half + F.floor((size - half) / 2)).cast("int")
    piece = lambda start, end: word.substr(start + 1, end - start)
    zero, end = F.lit(0), size
    # where the edit is: in the first, second, third or last part; what lies behind it is shifted
    pieces = [
        (zero, zero, first + longer, end + longer),
        (zero, first, half + longer, end + longer),
        (zero, half, third + longer, end + longer),
        (zero, third, end + longer, end + longer),
    ]
    return F.array(*[F.xxhash64(F.lit(i), size, piece(a, b), piece(c, d)) for i, (a, b, c, d) in enumerate(pieces)])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): pairs of distinct words (columns word, n) exactly one edit apart, each once; ``b`` is longer, or as long and larger. Words have four letters or more."""
    index = words.select(F.explode(keys(F.col("word"), 0)).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    probe = words.select(F.explode(F.concat(keys(F.col("word"), 0), keys(F.col("word"), 1))).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    longer = F.length("b") - F.length("a")
    # keys are hashes, so lengths are compared again
    met = index.join(probe, "key").filter((longer == 1) | ((longer == 0) & (F.col("a") < F.col("b"))))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps word -> form end. Steps followed double with each round; there is no cycle, as forms are more frequent than their words."""
    spark = forms.sparkSession
    now, path = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved, new = store(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        done = moved.filter("moved").isEmpty()
        drop(spark, path)
        now, path = moved.select("word", "root"), new
        if done:
            return now


def group_spellings(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, every: int = EVERY,
) -> DataFrame:
    """Per word: its near words (``n_near``), the most frequent of them if it is ``ratio`` times as frequent or more (``form``, ``form_n``), and the end of that chain (``root``).

    Of near words that are equally frequent the smaller in code-point order is the form. A word without a form is its own root. Null, empty and wordless texts give
    nothing; texts of any length are read whole. Repeated rows count as often as they are there. Other columns are not read. An empty table gives
    an empty result. ``letters`` is at least 4, ``ratio`` at least 2, so chains are short: each step multiplies the count.
    """
    if letters < 4 or ratio < 2:
        raise ValueError("letters must be at least 4 and ratio at least 2")
    words, _ = store(word_counts(documents, doc_id=doc_id, text=text, letters=letters, occurrences=occurrences, every=every), "words")
    pairs, _ = store(near_pairs(words), "near-words")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    has = F.col("best.near_n") >= ratio * F.col("n")
    judged, _ = store(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best.near_n")).alias("form_n")), "judged")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
