"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, live, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours at the smallest node it knows."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join reads both sides as they were dealt and a large star's rows can be split
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points itself and its smaller neighbours at the smallest of them."""
    down = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v. A row (node, root) for every node that has an edge; root is the component's smallest node.

    Sums are partial before each shuffle and no step gathers a node's neighbours. Every round
    is written out; it ends when a round changes nothing.
    """
    now, before = written(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    spark, kept = edges.sparkSession, live()[:-1]
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "stars")
        free(spark, [p for p in live()[:-1] if p not in kept])  # what only earlier rounds read
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
