"""Ranking, paging, capping and budgets, each with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.staging import stage


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order that must be total."""
    if not 0 <= offset <= 100_000:
        raise ValueError("offset is from 0 to 100000")
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def latest_per(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns, as a map-side combined aggregate and not a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def top_per(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark drops all but k a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def numbered(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Rows with their number from 1 in a total order: the place in a range of it, after what the ranges before hold."""
    ranges = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    first, at = [], 0
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # a row for each shuffle partition, at most
        first.append((r["_range"], at))
        at += r["count"]
    before = df.sparkSession.createDataFrame(first, "_range int, _before long")
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")


def fair_cap(df: DataFrame, group: str, position: str, budget: int) -> DataFrame:
    """``budget`` rows dealt round-robin over groups, groups with most rows first (ties by name), each in its own order.

    A row's turn is its place in its group; only rows of the first ``budget`` turns can be dealt.
    """
    turns = top_per(df, [group], [F.col(position).asc()], budget, "turn")
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    return turns.join(sizes, group).orderBy("turn", F.desc("group_size"), group).limit(budget)


def budget_prefix(df: DataFrame, part: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each part up to the first that would pass the budget; the first row is always there."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    return df.withColumn("running", F.sum(size).over(w)).withColumn("nth", n).where((F.col("running") <= budget) | (F.col("nth") == 1))


def head_and_tail(df: DataFrame, part: Sequence[str], order: Sequence[str], head: int = 20, tail: int = 10) -> DataFrame:
    """The first and last rows of each part, and how many lie between."""
    w = W.partitionBy(*part)
    out = df.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    out = out.where((F.col("n") <= head) | (F.col("n") > F.col("total") - tail))
    return out.withColumn("omitted", F.greatest(F.col("total") - head - tail, F.lit(0)))


def islands(df: DataFrame, part: Sequence[str], first: str, last: str, gap: int = 1) -> DataFrame:
    """Ranges merged where they overlap or the next starts within ``gap`` of the last end: part, first, last and ranges."""
    w = W.partitionBy(*part).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("opens", F.coalesce(F.col(first) > reach + gap, F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*part, "island").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("ranges"))


def fixed_order(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    """Place of a value in a list; others after all."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out
