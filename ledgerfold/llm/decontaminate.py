"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification. DataFrame functions only.

Texts become words (lower-cased runs of letters and digits) and these become five-word shingles; an item of fewer words is one shingle of them all. The windows of an
item are the stretches of a document with as many words as the item. A window can only be similar to an item if they share one of the item's
rarest shingles (with similarity t of n shingles, one of the first n - ceil(t n) + 1 in order of rarity), so
windows are laid where such a seed occurs, at the shift at which it occurs in the item: nothing that could verify is left out.

Each window and each item gets a 64-bit SimHash of its words. An item's radius follows from its length: a similar window has at most a ninth of its shingles, and so as many words,
changed; that bounds the angle, and four standard deviations are added to the expected distance. Items too short for any change have radius 0. The fingerprint is cut into ``radius + 1`` blocks:
two fingerprints at most ``radius`` bits apart agree in a block (pigeonhole), so looking up (seed, length, block number, block value) by equality finds all items with that seed within the
radius. What is found is held against the full distance, then against the exact weighted similarity: sum of the smaller over sum of the larger shingle counts, at least 0.8.

Verification is linear. An occurrence of a shingle counts for the shifts at which the window holds it, but fewer than the item's number of equal ones before it: one
interval of shifts. The sums of interval starts less ends give the shared shingles at every shift.

Scale. Documents are not shuffled: they test their shingles against bit arrays of the benchmark's seeds (scalars, their size
bounded by the benchmark's), one for each range of item lengths. Only hits travel, with as many words around them as items of that range reach, so a passage that a third of all documents share
costs a row each. Equal passages are looked up and verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.llm.common import store

SHINGLE, PERCENT = 5, 80
#: Standard deviations of the distance that the radius allows for, and the base of the ranges of item lengths.
DEVIATIONS, RANGE = 4.0, 4
#: Bits of the seed array for each seed, and its largest size in 64-bit numbers.
SEED_BITS, MOST_NUMBERS = 1024, 1 << 21


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: str, k: int = SHINGLE) -> str:
    """SQL: hashes of the ``k``-word shingles of an array of word hashes; empty if it is too short."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"if(size({words}) < {k}, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size({words}) - {k})), i -> xxhash64({parts})))"


def _by_kind(words: str) -> str:
    """SQL: the shingles of as many words as column ``k`` says."""
    return "case k " + " ".join(f"when {k} then {_shingles(words, k)}" for k in range(1, SHINGLE + 1)) + " end"


def _simhash(words: str) -> str:
    """SQL: bit b is set if more of the words' hashes have it than have not."""
    votes = f"aggregate({words}, 0, (s, x) -> s + if(getbit(x, b) = 1, 1, -1))"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if({votes} > 0, shiftleft(1L, b), 0L))"


def _radius() -> str:
    """SQL: the radius of an item of ``n`` words, ``changed`` of which a similar window may lack."""
    share = "acos(1 - changed / n) / pi()"
    return f"if(changed = 0, 0, least(63, cast(ceil(64 * {share} + {DEVIATIONS} * sqrt(64 * {share} * (1 - {share}))) as int)))"


#: SQL: the blocks of fingerprint ``fp`` as (number, value), one more than ``radius``.
_BLOCKS = """transform(sequence(0, radius), i -> struct(i as block,
  shiftrightunsigned(shiftleft(fp, cast(64 - (64 * (i + 1)) div (radius + 1) as int)), cast(64 - (64 * (i + 1)) div (radius + 1) + (64 * i) div (radius + 1) as int)) as value))"""


def _seeds(items: DataFrame) -> DataFrame:
    """(shingle, item, n, k, range, changed, radius, offset): for each item the shingles of which a similar window must have one, rarest first."""
    each = items.select("item", "n", "k", "range", "changed", "radius", F.posexplode("shingles").alias("offset", "shingle"))
    spread = each.groupBy("shingle").agg(F.count_distinct("item").alias("items"))
    rank = F.row_number().over(W.partitionBy("item", "n").orderBy("items", "shingle", "offset"))
    total = F.col("n") - F.col("k") + 1
    needed = total - F.ceil(total * PERCENT / 100) + 1
    return each.join(spread, "shingle").withColumn("rank", rank).filter(F.col("rank") <= needed).drop("items", "rank")


def _bit_array(seeds: DataFrame, numbers: int) -> Column:
    """One array of ``numbers`` 64-bit numbers with a bit for each seed, as a scalar."""
    at = F.shiftrightunsigned("shingle", 6).bitwiseAND(F.lit(numbers - 1))
    set_ = seeds.select("shingle").distinct().groupBy(at.alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shingle & 63 as int))")).alias("bits"))
    every = seeds.sparkSession.range(numbers).join(set_, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the benchmark items that documents contain.

    One row for each pair with a window at least 80 % similar: the best similarity, the first word (from 0) of the first window that has
    it, and the window's words. Windows are as long as the item, or reach as far as the document. All window shifts within a ninth of the item around a
    shared shingle are tried, which is as far as a window can be off and still verify.

    Case, punctuation and line breaks do not count. Items of fewer than five words are found where all their words stand in a row. Null texts, and texts without words, match
    nothing. Texts and items of any length are read whole. Rows that share a document id are searched each and reported as
    one; so are null ids. Repeated items count each under its id; of items that share an id the best window counts. Other columns are ignored. Empty tables give an empty result.
    """
    items = benchmark.select(F.col(item_id).alias("item"), word_hashes(F.col(item_text)).alias("words")).withColumn("n", F.size("words")).filter(F.col("n") > 0)
    items = items.withColumn("k", F.least("n", F.lit(SHINGLE))).withColumn("shingles", F.expr(_by_kind("words"))).withColumn("fp", F.expr(_simhash("words")))
    items = items.withColumn("changed", F.floor((F.col("n") - F.col("k") + 1) / 9).cast("int")).withColumn("radius", F.expr(_radius())).withColumn("range", F.ceil(F.log(float(RANGE), "n")).cast("int"))
    items, _ = store(items.withColumn("entry", F.xxhash64("item", "words")), "leak-items")
    seeds, _ = store(_seeds(items), "leak-seeds")
    # One row for each range of lengths: about a dozen, however large the benchmark.
    kinds = seeds.groupBy("k", "range").agg(F.count_distinct("shingle").alias("distinct"), F.max("n").alias("longest"), F.max("changed").alias("slack")).collect()
    docs = documents.select(F.col(doc_id).alias("doc"), word_hashes(F.col(text)).alias("words")).filter(F.size("words") > 0)
    found, reach = [], []
    for j, kind in enumerate(kinds):
        numbers = 64
        while numbers * 64 < SEED_BITS * kind["distinct"] and numbers < MOST_NUMBERS:
            numbers *= 2
        bits, _ = store(_bit_array(seeds.filter((F.col("k") == kind["k"]) & (F.col("range") == kind["range"])), numbers), "leak-bits")
        docs = docs.withColumn(f"bits{j}", bits.scalar())
        held = f"getbit(bits{j}[cast(shiftrightunsigned(x.shingle, 6) & {numbers - 1}L as int)], cast(x.shingle & 63 as int)) = 1"
        found.append(f"transform(filter(places{kind['k']}, x -> {held}), x -> struct({kind['k']} as k, {kind['range']} as range, x.shingle as shingle, x.place as place))")
        reach.append(f"when k = {kind['k']} and range = {kind['range']} then {kind['longest'] + kind['slack'] + 1}")
    if not kinds:
        found, reach = ["cast(array() as array<struct<k: int, range: int, shingle: bigint, place: int>>)"], ["when true then 1"]
    for k in sorted({kind["k"] for kind in kinds}):
        docs = docs.withColumn(f"places{k}", F.expr(f"transform({_shingles('words', k)}, (h, p) -> struct(h as shingle, p as place))"))

    # Hits: places where a document has a seed, with the words around them. No shuffle.
    hits = docs.select("doc", "words", F.explode(F.expr(f"concat({', '.join(found)})")).alias("hit")).select("doc", "words", "hit.*").withColumn("reach", F.expr(f"case {' '.join(reach)} end"))
    near = hits.select("doc", "k", "range", "shingle", "place", F.greatest(F.lit(0), F.col("place") - F.col("reach")).alias("low"), F.expr("slice(words, greatest(0, place - reach) + 1, 2 * reach)").alias("around"), F.size("words").alias("size"))

    # Windows: one for each item length and shift at which a seed fits.
    windows = near.join(seeds.select("shingle", "k", "range", "n", "changed", "radius", "offset").distinct(), ["shingle", "k", "range"])
    windows = windows.withColumn("end", F.greatest(F.lit(0), F.col("size") - F.col("n"))).withColumn("start", F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), F.col("end"))))
    windows = windows.withColumn("first", F.greatest(F.lit(0), F.col("start") - F.col("changed"))).withColumn("last", F.least(F.col("start") + F.col("changed"), F.col("end")))
    windows = windows.select("doc", "shingle", "k", "n", "radius", "first", F.expr("slice(around, start - low + 1, n)").alias("words"), F.expr("slice(around, first - low + 1, last - first + n)").alias("wide"))
    windows = windows.withColumn("content", F.xxhash64("words")).withColumn("passage", F.xxhash64("wide", "n"))
    windows, _ = store(windows.dropDuplicates(["doc", "shingle", "n", "first", "content", "passage"]), "leak-windows")

    # The multi-index, over distinct contents: equal passages are looked up once.
    contents = windows.groupBy("content", "shingle", "n", "radius").agg(F.first("words").alias("words")).withColumn("fp", F.expr(_simhash("words"))).drop("words")
    keyed = lambda df: df.withColumn("key", F.explode(F.expr(_BLOCKS))).select("*", "key.block", "key.value").drop("key")
    theirs = keyed(seeds.select("item", "n", "shingle").distinct().join(items.select("item", "n", "entry", "fp", "radius"), ["item", "n"]).select("shingle", "n", "entry", "fp", "radius")).drop("radius").withColumnRenamed("fp", "item_fp")
    matched = keyed(contents).join(theirs, ["shingle", "n", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= F.col("radius"))
    matched, _ = store(matched.select("content", "shingle", "n", "entry").distinct(), "leak-candidates")
    pairs, _ = store(windows.select("doc", "shingle", "n", "first", "content", "passage").join(matched, ["content", "shingle", "n"]).select("doc", "first", "passage", "entry").distinct(), "leak-pairs")

    # Verification of every shift, once for each passage and item. ``both``: shared shingles at shift s.
    passages = windows.dropDuplicates(["passage"]).select("passage", "k", "wide")
    tried = pairs.select("passage", "entry").distinct().join(passages, "passage")
    places = tried.select("passage", "entry", F.size("wide").alias("length"), F.posexplode(F.expr(_by_kind("wide"))).alias("place", "shingle"))
    counts = items.select("entry", "n", "k", F.explode("shingles").alias("shingle")).groupBy("entry", "n", "k", "shingle").agg(F.count("*").alias("c"))
    same = places.join(counts, ["entry", "shingle"]).groupBy("passage", "entry", "shingle", "length", "n", "k", "c").agg(F.sort_array(F.collect_list("place")).alias("places"))
    span = F.least("n", "length")
    each = same.withColumn("shingles", span - F.col("k") + 1).withColumn("shifts", F.col("length") - span)
    each = each.select("passage", "entry", "n", "k", "shingles", "shifts", F.posexplode("places").alias("j", "place"), F.expr("places").alias("places"), "c")
    low = F.greatest(F.lit(0), F.col("place") - F.col("shingles") + 1, F.expr("if(j >= c, get(places, cast(j - c as int)) + 1, 0)"))
    high = F.least("place", "shifts")
    steps = each.select("passage", "entry", "n", "k", "shingles", low.alias("low"), high.alias("high")).filter("low <= high")
    steps = steps.select("passage", "entry", "n", "k", "shingles", F.explode(F.array(F.struct(F.col("low").alias("s"), F.lit(1).alias("d")), F.struct((F.col("high") + 1).alias("s"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy("passage", "entry", "n", "k", "shingles", F.col("x.s").alias("s")).agg(F.sum("x.d").alias("d"))
    both = steps.withColumn("both", F.sum("d").over(W.partitionBy("passage", "entry").orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)))
    both = both.withColumn("either", F.col("shingles") + F.col("n") - F.col("k") + 1 - F.col("both")).filter(F.col("both") * 100 >= F.col("either") * PERCENT)
    good = both.groupBy("passage", "entry").agg(F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("s")).alias("shift"), (F.col("shingles") + F.col("k") - 1).alias("words"))).alias("best"))
    rows = pairs.join(good, ["passage", "entry"]).join(items.select("entry", "item"), "entry")
    best = F.max(F.struct("best.similarity", (F.col("best.shift") - F.col("first")).alias("place"), "best.words")).alias("best")
    out = rows.groupBy("doc", "item").agg(best)
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "best.similarity", (-F.col("best.place")).cast("long").alias("start_word"), F.col("best.words").cast("long").alias("n_words"))
