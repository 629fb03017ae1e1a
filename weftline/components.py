"""Connected components as alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.staging import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("hi", "m").alias("m"))
    return (
        both.where("lo > hi")
        .join(least, F.col("hi") == F.col("node"))
        .where("lo != m")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least.withColumnRenamed("hi", "node"), F.col("hi") == F.col("node")).where("lo != m")
    return moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.withColumnRenamed("m", "lo")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    Rows with a null end, loops and repeated edges are ignored. Each round keeps at most one row per
    edge and uses only map-side combined aggregates and equi-joins, so a node with very many edges is
    never gathered into one row. Rounds stop when the edge table no longer changes, after O(log n)
    of them in practice; every round is staged, so lineage stays one round long.
    """
    now = stage(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .distinct(),
        "edges",
    )

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        new = stage(_small_star(_large_star(now)), "edges")
        unstage(now)
        now, was = new, seen
        seen = mark(now)
        if seen == was:
            break
    ends = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(ends)
