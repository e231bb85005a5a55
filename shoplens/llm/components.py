"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import staged


def components(links: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, label): each linked node's smallest reachable node.

    Every round is written to the shared folder, so lineage stays one round
    long. Grouping a node's neighbours uses a minimum only (a partial
    aggregate); the neighbours themselves are never gathered.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(edges, f"{label}_edges")
    before = None
    for _ in range(most_rounds):
        # Large star: each node's larger neighbours move to its smallest neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node's smaller neighbours, and the node, move to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        edges = staged(small.where("u <> v").distinct(), f"{label}_round")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return staged(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), f"{label}_labels")
