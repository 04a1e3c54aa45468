"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the output over its share of the corpus. A document of a source with rate r is
repeated k times, where k is drawn from the Poisson distribution of mean r by inversion: a uniform number made from
a hash of the seed and the id is looked up in the distribution's cumulative sums. So every document is decided alone, from its
id: any executor draws the same number again, rates below one thin a source, rates above repeat it, and expected sizes are exact for any
rate. Copies are then dealt to partitions by a hash of seed, id and copy number, and sorted by it: one global shuffle, in which a
source or document that fills a third of the corpus lands on all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.llm.common import fresh, store

SEED = 17
EXPONENT = 0.7


def uniform(seed: int, doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of seed and id; a null id counts as the text ''."""
    digest = F.md5(F.concat(F.lit(f"{seed}:draw:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def repetition_rates(documents: DataFrame, *, text: str = "text", source: str = "source", targets: DataFrame | None = None, exponent: float = EXPONENT, total: float = 1.0) -> DataFrame:
    """(source, size, rate): code points in the source, and how often each of its documents is to be repeated on average.

    ``targets`` (source, weight) gives the wanted shares of the output's code points, up to a factor; sources that it leaves out get none.
    Without it, a source's weight is its size to the power ``exponent``. The output is ``total`` times as large as the corpus.
    """
    sizes = documents.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("double").alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(exponent)))
    else:
        wanted = targets.select(F.col("source").alias("wanted"), F.col("weight").cast("double")).groupBy("wanted").agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(wanted, sizes["source"].eqNullSafe(wanted["wanted"]), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_weight, all_size = weighted.agg(F.sum(F.when(F.col("size") > 0, F.col("weight"))), F.sum("size")).first()  # two numbers
    if not all_weight:
        return weighted.select("source", "size", F.lit(0.0).alias("rate"))
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(all_weight) * F.lit(float(total)) * F.lit(all_size) / F.col("size")).otherwise(F.lit(0.0))
    return weighted.select("source", "size", rate.alias("rate"))


def _cumulative(rates: DataFrame) -> DataFrame:
    """Adds ``cdf``: the Poisson distribution's cumulative sums for 0, 1, ..., as far as a draw of 52 bits can tell."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    logs = rates.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = W.partitionBy("source").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log("k"))
    mass = F.when(F.col("rate") > 0, F.exp(F.sum(step).over(upto))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    sums = logs.withColumn("mass", mass).withColumn("sum", F.sum("mass").over(upto))
    return sums.groupBy("source", "rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sum"))), lambda x: x["sum"]).alias("cdf"))


def mix_sources(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: DataFrame | None = None, exponent: float = EXPONENT, total: float = 1.0, seed: int = SEED,
    copy_no: str = "copy_no", n_copies: str = "n_copies", shuffle_key: str = "shuffle_key",
) -> DataFrame:
    """Every document as often as drawn, in global random order, with ``copy_no`` (from 1), ``n_copies`` and ``shuffle_key``.

    See :func:`repetition_rates` for the rates. Rows of a null source form a source of their own. Documents without text have size 0 but
    are drawn like the others of their source; a source with no text at all has rate 0. Rows that share an id are drawn alike. Other columns pass
    through; columns named like the three results are replaced. An empty table gives an empty result.
    """
    base = documents.drop(copy_no, n_copies, shuffle_key)
    # Written, so that its size is known and Spark broadcasts it only if it is small.
    table, _ = store(_cumulative(repetition_rates(documents, text=text, source=source, targets=targets, exponent=exponent, total=total)), "rates")
    of, cdf = fresh(base, "of", "cdf")
    table = table.select(F.col("source").alias(of), F.col("cdf").alias(cdf))
    drawn = base.withColumn(n_copies, uniform(seed, F.col(doc_id))).join(table, base[source].eqNullSafe(table[of]))
    drawn = drawn.withColumn(n_copies, F.size(F.filter(F.col(cdf), lambda c: c < F.col(n_copies)))).drop(of, cdf).filter(F.col(n_copies) > 0)
    copies = drawn.withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    key = F.md5(F.concat(F.lit(f"{seed}:place:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(copy_no).cast("string")).cast("binary"))
    return copies.withColumn(shuffle_key, key).repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key)
