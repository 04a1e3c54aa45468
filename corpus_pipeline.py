"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it leaves of ``docs``; :func:`run` writes that as Parquet into the
shared folder and gives it to the next. All but the last return the columns of ``documents``; other columns of the input are left behind. Rows without an id cannot be told apart
by the stages that decide by id: near-dedup and decontamination let them pass. Null and empty texts pass every stage. Rows that share an id share its fate in
those two stages; near-dedup keeps one row of each id and text, the one that sorts first by its other columns. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import toxicity
from ledgerfold.llm.common import store
from ledgerfold.llm.decontaminate import find_leaks
from ledgerfold.llm.line_dedup import dedup_lines
from ledgerfold.llm.mixing import mix_sources
from ledgerfold.llm.queries import TOXIC_FROM, table
from ledgerfold.llm.superminhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of the toxicity query."""
    model = toxicity.train(toxicity.training_rows(docs), toxicity.training_rows(table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs.select(COLUMNS), model, score="toxic_score").filter(F.col("toxic_score") < TOXIC_FROM).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more share; ``n_chars`` counts what is left."""
    return dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Five-word shingles, similarity 0.8."""
    extra = near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct()
    extra, _ = store(extra, "near-extra")
    rest = docs.select(COLUMNS).join(extra, "doc_id", "left_anti")
    # repeated rows of an id: one of each text stays; rows without an id stay
    twice = rest.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = rest.join(twice, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256)).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return rest.join(twice, "doc_id", "left_anti").unionByName(several).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    leaks, _ = store(find_leaks(docs, table(spark, sf_dir, "benchmark")).filter("doc_id is not null").select("doc_id").distinct(), "leaks")
    return docs.select(COLUMNS).join(leaks, "doc_id", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to the power 0.7 of their size, globally shuffled."""
    return mix_sources(docs.select(COLUMNS))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("source_mix", mix)]

#: The toxicity stage learns a model, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
