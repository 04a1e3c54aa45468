"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Six measures of a text are held against cutoffs, one for each stratum (language) and measure. The cutoffs come from a
labelled holdout: texts labelled good, all of them, that pass the fixed base rules. For a cutoff that rejects k of a stratum's n good texts, the exact binomial
probability of k or fewer rejections, if the true rate were the measure's share of ``risk``, is its p-value. Cutoffs are tested from the mildest on, in fixed order, each at
``error / (measures * strata)``, and testing stops at the first that fails: with probability 1 - ``error``, no stratum loses more
than ``risk`` of its good texts to all measures together (fixed-sequence testing within, Bonferroni between, a union bound over
measures). Of the certified cutoffs the one that rejects most texts labelled bad is taken, the mildest of several. A stratum with too few good
texts to certify anything keeps all its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.llm.common import BLANKS, fresh, store, strip_blanks, words

SYMBOLS = "#*$%&|<>"
RISK, ERROR = 0.05, 0.05
#: Measures (SQL over the base columns) and their cutoffs, a text failing if it is above; from mild to strict.
MEASURES = {
    "long_words": ("try_divide(word_chars, n_words)", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0]),
    "short_words": ("try_divide(-word_chars, n_words)", [-1.0, -1.5, -2.0, -2.5, -2.75, -3.0, -3.25, -3.5, -3.75, -4.0]),
    "symbols": ("try_divide(n_symbols, word_chars)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005]),
    "repeated_lines": ("try_divide(n_dup_lines, n_text_lines)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "repeated_words": ("try_divide(n_repeat_words, n_words)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "top_heavy_lines": ("try_divide(n_words, n_text_lines)", [5000.0, 2000.0, 1000.0, 700.0, 500.0, 400.0, 300.0, 250.0, 200.0]),
}
#: Repeated three-word windows of sorted (hash, place) pairs ``t``: words in any of them.
_REPEATED = """
aggregate(
  sort_array(transform(filter(t, (x, i) -> (i > 0 and t[greatest(i - 1, 0)].h = x.h) or (i < size(t) - 1 and t[least(i + 1, size(t) - 1)].h = x.h)), x -> x.p)),
  struct(0L as total, 0L as upto),
  (a, p) -> struct(a.total + p + 3 - greatest(a.upto, cast(p as bigint)) as total, cast(p + 3 as bigint) as upto),
  a -> a.total)
"""


def base_measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_text_lines (long) and base_failed; drops ``text``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: strip_blanks(line) != "")
    w, t, s = fresh(documents, "w", "t", "s")
    df = documents.withColumn(w, words(F.col(text))).withColumn(s, lines)
    windows = f"if(size({w}) < 3, cast(array() as array<struct<h:bigint,p:int>>), sort_array(transform(sequence(0, greatest(0, size({w}) - 3)), i -> struct(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]) as h, i as p))))"
    df = df.withColumn(t, F.expr(windows))
    n_lines = F.size(s)
    return df.select(
        *[F.col(f"`{c}`") for c in documents.columns if c != text],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED.replace("t[", f"{t}[").replace("filter(t,", f"filter({t},").replace("size(t)", f"size({t})")).alias("n_repeat_words"),
        n_lines.cast("long").alias("n_text_lines"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _step(measure: str) -> Column:
    """How many of the measure's cutoffs a text is above."""
    value, cutoffs = MEASURES[measure]
    level = F.expr(value).cast("double")
    return F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: level > c))


def _binomial(k: str, n: str, p: float) -> str:
    """SQL: probability of at most ``k`` successes of ``n``, summed exactly in logarithms; 1 where ``k`` is above the mean."""
    start = f"struct({n} * ln(1 - {p}D) as l, exp({n} * ln(1 - {p}D)) as s)"
    step = f"(a, i) -> struct(a.l + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D)) as l, a.s + exp(a.l + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D))) as s)"
    return f"if({k} > {n} * {p}D, 1D, aggregate(if({k} < 1, cast(array() as array<bigint>), sequence(1L, greatest({k}, 1L))), {start}, {step}, a -> a.s))"


def certify(holdout: DataFrame, *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, measure, cutoff): the chosen cutoffs. ``holdout`` has stratum, good (boolean) and the base columns."""
    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(len(MEASURES[m][1])).alias("cutoffs"), _step(m).alias("step")) for m in MEASURES])).alias("x")
    counts = holdout.filter("not base_failed").select("stratum", "good", steps).groupBy("stratum", "x.measure", "x.cutoffs", "x.step")
    counts = counts.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    level = F.explode(F.sequence(F.lit(1), F.col("cutoffs"))).alias("level")  # 1: the mildest
    # A text above s cutoffs is above the s strictest.
    fails = counts.select("stratum", "measure", "cutoffs", "step", "good", "bad", level).withColumn("fails", F.col("level") > F.col("cutoffs") - F.col("step"))
    levels = fails.groupBy("stratum", "measure", "level").agg(F.sum("good").alias("n"), F.sum(F.when(F.col("fails"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("fails"), F.col("bad")).otherwise(0)).alias("caught"))
    strata = holdout.select("stratum").distinct().count()
    p_value = F.expr(_binomial("k", "n", risk / len(MEASURES)))
    tested = levels.withColumn("failed", (p_value > F.lit(error / (len(MEASURES) * max(1, strata)))).cast("int"))
    in_order = W.partitionBy("stratum", "measure").orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)
    certified = tested.withColumn("failed", F.max("failed").over(in_order)).filter("failed = 0 and caught > 0")
    best = certified.groupBy("stratum", "measure").agg(F.max(F.struct("caught", (-F.col("level")).alias("mild"))).alias("best"))
    cutoff = F.coalesce(*[F.when(F.col("measure") == m, F.element_at(F.array(*[F.lit(c) for c in cutoffs]), -F.col("best.mild"))) for m, (_, cutoffs) in MEASURES.items()])
    return best.select("stratum", "measure", cutoff.alias("cutoff"))


def judge_quality(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", quality: str = "quality", risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """Per row of ``documents``: id, the base columns, base_failed, kept, and failed (the measures that rejected it, '' if none).

    Words are runs without blanks (space, tab to carriage return); null, empty and blank texts have none and fail the base rules. A null stratum is a
    stratum of its own. Of several labels for an id the lowest counts; labels that are null or not 0 or 1, and those without a
    document, are left out. Rows that share an id each count in the holdout, and are judged each. Without labels only the base rules decide. Texts of any length are read whole; only their measures are
    shuffled. Of cutoffs that reject as many bad texts the mildest is taken. Other columns are ignored, whatever their names. An empty table gives an empty result.

    The guarantee is about good texts that pass the base rules; what the base rules reject is not part of it.
    """
    measured = base_measures(documents.select(F.col(doc_id).alias("id"), F.col(stratum).alias("stratum"), F.col(text).alias("text")))
    measured, _ = store(measured, "quality-measures")
    known = labels.select(F.col(doc_id).alias("id"), F.col(quality).cast("int").alias("quality")).filter("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    holdout, _ = store(measured.join(known, "id").withColumn("good", F.col("quality") == 1), "quality-holdout")
    cutoffs = certify(holdout, risk=risk, error=error)
    # Written, so that its size is known: Spark broadcasts it only if it is small.
    wide, _ = store(cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("measure") == m, F.col("cutoff"))).alias(m) for m in MEASURES]).withColumnRenamed("stratum", "of"), "quality-cutoffs")
    joined = measured.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = F.array_join(F.filter(F.array(*[F.when(F.expr(value).cast("double") > F.col(m), F.lit(m)) for m, (value, _) in MEASURES.items()]), lambda x: x.isNotNull()), ",")
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(failed)
    return joined.select(F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (failed == "").alias("kept"), failed.alias("failed"))
