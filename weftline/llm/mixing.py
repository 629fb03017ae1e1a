"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's target over its
size; the whole part is taken as it is and the rest is rounded dependently. Two documents with
fractional copies pass words from one to the other until one of them is whole, in a direction drawn
so that expectations stay; the words they take together never change. Blocks of documents are folded
from the largest document down, and what each leaves unrounded, one document at most, goes up a tree
of blocks of blocks. Only the last of a source is rounded alone, to the nearer side, so its taken
words miss the target by half of that one document at most. Rows that repeat an id, a size and a source
are one unit: rounding them against each other leaves some with a copy more and one of them fractional, which is
what their count says.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 64
NEAR = 1e-9
KEY = ("doc_id", "source", "size")


def words(text: str) -> Column:
    """Words of a text, 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, part) of each row; part is the number of the task that read it."""
    return docs.select("doc_id", "source", words("text").alias("size"), F.spark_partition_id().alias("part"))


def same_row(of: str = "of_") -> Column:
    """Whether the row's id, source and size are those of the columns with that prefix."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(of + c)) for c in KEY])


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size, c: how many are equal): weights repeat over the sources by code point, null last.

    The targets share ``share`` of all words by weight, no more than ``most`` times its size each, and
    the excess goes to the others by weight: the least of the cap and level times weight. Each round of
    one aggregate finds who is above its cap at the level and raises the level for the others, until
    nobody joins them. Sources are ranked by ranges, so their number is not bounded by one task.
    """
    by = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"))
    ranges = stage(by.where("source is not null").repartitionByRange("source").withColumn("range", F.spark_partition_id()), "sources")
    first, at = [], 0
    for r in ranges.groupBy("range").count().orderBy("range").collect():  # a row for each shuffle partition, at most
        first.append((r["range"], at))
        at += r["count"]
    before = sized.sparkSession.createDataFrame(first, "of int, before long")
    place = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("source")) - 1
    named = ranges.join(before, F.col("range") == F.col("of")).select("source", "source_size", place.alias("place"))
    unnamed = sized.where("source is null").groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")).withColumn("place", F.lit(at).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    by = stage(named.unionByName(unnamed).select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "sources")
    whole, level, over = by.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        capped = F.col("weight") * level > F.col("cap") if over >= 0 else F.lit(False)
        n, spent, free = by.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == over:
            break
        over, level = n, (share * whole - (spent or 0)) / free if free else float("inf")
    return by.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


_UNIT = "struct<size: bigint, mixed: bigint, doc_id: bigint, base: bigint, p: double, u: double>"
_DONE = "struct<doc_id: bigint, size: bigint, more: bigint>"


def _fold():
    """One block: an array of fractional units, largest first, to (rounded units, at most one left)."""
    near = f"{NEAR}D"
    whole = lambda x: f"named_struct('doc_id', {x}.doc_id, 'size', {x}.size, 'more', {x}.base + if({x}.p > 0.5, 1L, 0L))"
    is_whole = lambda x: f"({x}.p < {near} or {x}.p > 1 - {near})"
    moved = lambda x, d: f"named_struct('size', {x}.size, 'mixed', {x}.mixed, 'doc_id', {x}.doc_id, 'base', {x}.base, 'p', {x}.p + ({d}) / {x}.size, 'u', {x}.u)"
    give = "least(s.left.p * s.left.size, (1 - b.p) * b.size)"  # words the left unit can pass to b
    get = "least(b.p * b.size, (1 - s.left.p) * s.left.size)"
    # b draws the direction; the words moved come first in the struct, so the lambda below can name them.
    words = f"if(b.u * ({give} + {get}) < {get}, -{give}, {get})"
    pair = f"transform(array({words}), w -> named_struct('a', {moved('s.left', 'w')}, 'b', {moved('b', '-w')}))[0]"
    settle = f"""transform(array({pair}), q -> named_struct(
        'done', concat(s.done, if({is_whole('q.a')}, array({whole('q.a')}), cast(array() as array<{_DONE}>)), if({is_whole('q.b')}, array({whole('q.b')}), cast(array() as array<{_DONE}>))),
        'left', case when not {is_whole('q.a')} then q.a when not {is_whole('q.b')} then q.b end))[0]"""
    first = f"if({is_whole('b')}, named_struct('done', concat(s.done, array({whole('b')})), 'left', s.left), named_struct('done', s.done, 'left', b))"
    return F.expr(f"""aggregate(units, named_struct('done', cast(array() as array<{_DONE}>), 'left', cast(null as {_UNIT})),
        (s, b) -> case when s.left is null or {is_whole('b')} then {first} else {settle} end)""")


def _draw(level: int):
    return (F.pmod(F.xxhash64("mixed", "size", F.lit(level)), F.lit(1 << 53)) / float(1 << 53)).alias("u")


def rounded(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, m, base, more) for each distinct row of ``sized``.

    Of its ``m`` equal rows each takes ``base`` copies and ``more`` of them take one copy beyond that.
    """
    aims = stage(targets(sized, weights, share, most), "targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.groupBy(*KEY).agg(F.sum("c").alias("m")).join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + NEAR))
    # Equal rows settle among themselves all but what is left of their sum.
    rows = rows.withColumn("sum", F.col("m") * F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    rows = stage(rows.withColumn("settled", F.when(F.col("size") > 0, F.floor(F.col("sum") + NEAR)).otherwise(0)).withColumn("mixed", F.xxhash64("doc_id", "size", "source")), "rows")

    blocks = max(1, -(-rows.count() // FAN))
    unit = lambda level: F.struct("size", "mixed", "doc_id", "base", "p", _draw(level))
    # A hash deals the documents of all sources to blocks; within each, sources are folded apart.
    fraction = rows.where("size > 0").select("source", "size", "mixed", "doc_id", F.col("settled").alias("base"), F.greatest(F.col("sum") - F.col("settled"), F.lit(0.0)).alias("p"))
    now = fraction.select("source", F.pmod(F.xxhash64("mixed", F.lit("deal")), F.lit(blocks)).alias("block"), unit(0).alias("unit"))
    finished, level = rows.where("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("more")), 0
    while True:
        units = now.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = stage(units.select("source", "block", _fold().alias("s")), "rounded")
        finished = finished.unionByName(folded.select("source", F.inline("s.done")))
        left = folded.where("s.left is not null").select("source", "block", "s.left.*").drop("u")
        if blocks == 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
        now = left.select("source", F.floor(F.col("block") / FAN).alias("block"), unit(level).alias("unit"))
    # The last of a source has no partner: it goes to the nearer side.
    alone = left.select("source", "doc_id", "size", (F.col("base") + (F.col("p") >= 0.5).cast("long")).alias("more"))
    done = finished.unionByName(alone).select(*[F.col(c).alias(f"of_{c}") for c in KEY], "more")
    return rows.join(done, same_row()).select(*KEY, "source_size", "target", "m", "base", "more")


def before(cells: DataFrame) -> Column:
    """Equal rows in the parts before a row's, for (doc_id, source, size, part, c): as many rows a key as it has parts."""
    return F.sum("c").over(W.partitionBy(*KEY).orderBy("part")) - F.col("c")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for every row of ``docs`` (doc_id, text, source).

    taken is copies times size. Copies are drawn by hashes of ids and sizes, so reruns agree. A row
    without words, its text null or blank, takes none and has the whole part of its source's rate as
    copies. A null source is a source of its own, the last. Repeated rows are rounded together, and each
    has the whole part or one copy more; a null doc_id is carried along; other columns are ignored. An
    empty table gives no rows.
    """
    cells = stage(sizes(docs).groupBy(*KEY, "part").agg(F.count("*").alias("c")), "sizes")
    plan = rounded(cells, weights, share, most).withColumnsRenamed({c: f"of_{c}" for c in KEY})
    rows = cells.withColumn("before", before(cells)).join(plan, same_row())
    # No part has more equal rows than one task has read.
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    copies = F.col("base") + (F.col("before") + F.col("i") <= F.col("more")).cast("long")
    return rows.withColumn("copies", copies.cast("int")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
