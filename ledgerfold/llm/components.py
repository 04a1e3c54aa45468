"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import drop, store


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): for each end of an edge (columns a, b) the smallest id reachable from it.

    Union-find by rounds: each node takes the smallest label among itself and its neighbours, then the label of
    its label (path halving), until nothing changes. Rounds are about the logarithm of the longest chain.
    A node with very many neighbours is pre-aggregated on the map side; each round is written to the shared folder, in as many files as
    its rows need. ``edges`` are read twice and should be stored.
    """
    spark, rows = edges.sparkSession, 2 * edges.count()
    ends = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    links, links_path = store(ends.union(ends.select("b", "a")).distinct(), "links", rows)
    labels, path = store(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")), "labels", rows)
    for _ in range(max_rounds):
        told = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(told, "id").select("id", "label", F.least("label", "near").alias("next"))
        target = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        # the label's own label before this round; it is a node of the same component and never larger
        stepped = moved.join(target, "next").select("id", "label", F.least("next", "beyond").alias("next"))
        new, new_path = store(stepped, "labels", rows)
        done = new.filter("next <> label").isEmpty()
        drop(spark, path)
        labels, path = new.select("id", F.col("next").alias("label")), new_path
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    drop(spark, links_path)
    return labels.select("id", F.col("label").alias("component"))
