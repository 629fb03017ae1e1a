"""Exact top-k by inner product as a Voronoi kNN join.

Data are grouped by their nearest pivot, queries by the nearest of fewer pivots. A group's summary is
its pivot ``p`` and radius ``r``; by Cauchy-Schwarz no vector of the group scores more than
``q.p + |q| r`` with a query ``q``. Each query is first solved against one chunk of its own data group, which
bounds its k-th score from below. A query group then needs the data groups whose upper bound is no
lower than that for one of its queries; only their chunks are sent to it, and queries only to the
slices that hold such chunks. There, chunks' own centres and radii spare further products.

Vectors of many independent dimensions lie about as far from their pivot as from anything else, so
that few groups can be left out; ``topk`` reports the share of what is sent.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.staging import stage

SCALE = 256
PIVOT_BYTES = 16 * 1024 * 1024  # of all pivots, at most; there is one for each square root of the vectors
CELL = 1 << 16  # vectors of a group that one task cuts into chunks
CHUNK = 512
SLICE = 64  # chunks that one task streams through a query group
QUERIES = 2048  # queries of a group held at a time
CLOSE = 1e-9  # relative slack of bounds, far above what rounding can add up to
KINDS = {2: "<i2", 4: "<i4", 8: "<f8"}


def usable(embedding: Column) -> Column:
    """Not null, and no null or non-finite component."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, zero-filled to the width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles; where that leaves the range of doubles, the largest of them."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -np.finfo(float).max, np.finfo(float).max)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes a component that hold all rows."""
    most = np.abs(x).max(initial=0)
    return [r.tobytes() for r in x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")]


def unpacked(cells: list[bytes], width: int) -> np.ndarray:
    sizes = {len(c) for c in cells}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(cells), KINDS[sizes.pop() // width]).reshape(-1, width).astype(float)
    return np.stack([np.frombuffer(c, KINDS[len(c) // width]).astype(float) for c in cells])


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of each row's nearest pivot; which one decides nothing but what moves where."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt((x**2).sum(1))


HOMES = "pivot int, coarse int, near double, rid long, vec_id long, asks boolean, v binary"


def _homes(pivots: np.ndarray, coarse: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = quantised(matrix(batch[3], pivots.shape[1]))
                own = nearest(x, pivots)
                columns = [pa.array(own, pa.int32()), pa.array(nearest(x, pivots[:coarse]), pa.int32()), pa.array(norms(x - pivots[own])), batch[0], batch[1], batch[2], pa.array(packed(x), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HOMES.split(", ")])

    return run


CHUNKS = "pivot int, first boolean, n int, rids binary, ids binary, named binary, v binary, centre binary, radius double"


def _chunks(width: int):
    """Rows of a group, sorted by their distance to the pivot, in chunks."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 5, pa.float64()]

    def chunk(key, first, rows):
        rids, ids, cells = zip(*rows, strict=True)
        x = unpacked(cells, width)
        with np.errstate(over="ignore", invalid="ignore"):
            centre = x.mean(0)
            radius = norms(x - centre).max()
        named = np.array([i is not None for i in ids])
        return key[0], first and key[1] == 0, len(rows), np.array(rids, "<i8").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), named.tobytes(), b"".join(packed(x)), centre.tobytes(), float(radius)

    def run(batches):
        key, rows, first = None, [], True
        for batch in batches:
            out = []
            for pivot, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, part) != key or len(rows) == CHUNK:
                    if rows:
                        out.append(chunk(key, first, rows))
                    key, rows, first = (pivot, part), [], (pivot, part) != key
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(chunk(key, first, rows), types, strict=True)], names=names)

    return run


def _needs(pivots: np.ndarray, radius: np.ndarray):
    """(grp, block, pivot): the data groups that hold what may be among the k best of a query in the block."""
    size = norms(pivots)
    schema = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("pivot", pa.int32())])

    def run(batches):
        wanted: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                grp, block, theta = (part[i].to_numpy(zero_copy_only=False) for i in range(3))
                q = unpacked(part[3].to_pylist(), pivots.shape[1])
                own = norms(q)[:, None]
                theta = np.where(np.isnan(theta), -np.inf, theta)[:, None]
                with np.errstate(over="ignore", invalid="ignore"):
                    most = q @ pivots.T + own * radius
                    needed = ~(most < theta - CLOSE * (own * (size + radius) + np.abs(theta))) & (radius >= 0)
                for key in set(zip(grp.tolist(), block.tolist(), strict=True)):
                    hit = needed[(grp == key[0]) & (block == key[1])].any(0)
                    wanted[key] = wanted[key] | hit if key in wanted else hit
            while len(wanted) > 64:  # a block's rows come together; what is repeated is dropped later
                key = next(iter(wanted))
                yield emit(key, wanted.pop(key))
        for key, hit in wanted.items():
            yield emit(key, hit)

    def emit(key, hit):
        j = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(j), key[0]), pa.int32()), pa.array(np.full(len(j), key[1]), pa.int32()), pa.array(j, pa.int32())], schema=schema)

    return run


FOUND = "rid long, query_id long, vec_id long, score long"


def scores(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, held within 64 bits; exact unless below ``least`` (of each query)."""
    low, high = -(1 << 63), (1 << 63) - 1
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1]
        if bound < 1 << 53:
            return (q @ x.T).astype(np.int64)
        if bound < 1 << 62 and np.abs(q).max() < 1 << 62 and np.abs(x).max() < 1 << 62:
            return q.astype(np.int64) @ x.T.astype(np.int64)
        s = q @ x.T
        error = CLOSE * norms(q)[:, None] * norms(x)
        out = np.where(s < 0, low, high)
        # Python's integers where rounding or overflow could decide.
        open_ = ~(np.abs(s) - error > 2.0**63) & ~(s + error < least[:, None].astype(float))
        out[~open_ & (np.abs(s) < 2.0**63)] = low
    for i, j in zip(*np.nonzero(open_), strict=True):
        exact = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))
        out[i, j] = max(low, min(high, exact))
    return out


def _solve(width: int, k: int):
    """Each deal's queries come first and are held; its chunks stream by them."""
    schema = pa.schema([("rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    low = np.iinfo(np.int64).min

    class Deal:
        def __init__(self, key):
            self.key, self.asks, self.q = key, [], None
            self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
            self.named = np.zeros(0, bool)

        def add(self, rids, ids, named, x, centre, radius):
            if self.q is None:
                self.rid, self.ids, theta, cells = zip(*self.asks, strict=True)
                self.rid, self.q = np.array(self.rid), unpacked(cells, width)
                self.least = np.array([low if t is None else t for t in theta], np.int64)
                self.size, self.asks = norms(self.q), []
            with np.errstate(over="ignore", invalid="ignore"):
                most = self.q @ centre + self.size * radius
                some = np.flatnonzero(~(most < self.least - CLOSE * (self.size * (norms(centre[None])[0] + radius) + np.abs(self.least.astype(float)))))
            if not len(some):
                return
            s = scores(self.q[some], x, self.least[some])
            hit = (s >= self.least[some][:, None]) & (self.rid[some][:, None] != rids)
            if s.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(some):
                # Columns by id, so that a stable sort leaves the best k with ties to the smaller id.
                by_id = np.lexsort((ids, ~named))
                t = np.where(hit, s, low)[:, by_id]
                floor = np.partition(t, -k, axis=1)[:, -k][:, None]
                above, tie = t > floor, t == floor
                left = k - above.sum(1, keepdims=True)
                keep = (above | (tie & (np.cumsum(tie, 1) <= left))) & hit[:, by_id]
                r, c = np.nonzero(keep)
                c = by_id[c]
            else:
                r, c = np.nonzero(hit)
            row, score, id_, has = np.concatenate([self.row, some[r]]), np.concatenate([self.score, s[r, c]]), np.concatenate([self.id, ids[c]]), np.concatenate([self.named, named[c]])
            order = np.lexsort((id_, ~has, ~score, row))  # ~score falls as the score grows and can't overflow
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = order[place < k]
            self.row, self.score, self.id, self.named = row[place < k], score[keep], id_[keep], has[keep]
            last = np.flatnonzero(place == k - 1)
            kth = score[order[last]]
            self.least[row[last]] = np.maximum(self.least[row[last]], kth)

        def best(self):
            ids = [self.ids[i] for i in self.row]
            return pa.RecordBatch.from_arrays([pa.array(self.rid[self.row]), pa.array(ids, pa.int64()), pa.array(self.id, mask=~self.named), pa.array(self.score)], schema=schema)

    def run(batches):
        deal = None
        for batch in batches:
            for grp, block, part, member, rid, vec_id, theta, v, rids, ids, named, centre, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if deal is None or deal.key != (grp, block, part):
                    if deal is not None and len(deal.row):
                        yield deal.best()
                    deal = Deal((grp, block, part))
                if not member:
                    deal.asks.append((rid, vec_id, theta, v))
                elif deal.asks or deal.q is not None:
                    rids = np.frombuffer(rids, "<i8")
                    x = unpacked([v], len(rids) * width).reshape(-1, width)
                    deal.add(rids, np.frombuffer(ids, "<i8"), np.frombuffer(named, bool), x, np.frombuffer(centre), radius)
        if deal is not None and len(deal.row):
            yield deal.best()

    return run


def _solved(asked: DataFrame, chunks: DataFrame, needs: DataFrame, spread: int, width: int, k: int) -> DataFrame:
    """(rid, query_id, vec_id, score): the best k of each deal of queries (grp, block) with chunks of the pivots they need."""
    sent = needs.join(chunks, "pivot").withColumn("part", F.pmod(F.xxhash64("rids"), F.lit(spread)).cast("int"))
    none = {"rid": "long", "vec_id": "long", "theta": "long"}
    member = sent.select("grp", "block", "part", F.lit(True).alias("member"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "v", "rids", "ids", "named", "centre", "radius")
    parts = needs.join(chunks.select("pivot", F.pmod(F.xxhash64("rids"), F.lit(spread)).cast("int").alias("part")), "pivot").select("grp", "block", "part").distinct()
    held = {"rids": "binary", "ids": "binary", "named": "binary", "centre": "binary", "radius": "double"}
    ask = asked.join(parts, ["grp", "block"]).select("grp", "block", "part", F.lit(False).alias("member"), "rid", "vec_id", "theta", "v", *[F.lit(None).cast(t).alias(c) for c, t in held.items()])
    dealt = ask.unionByName(member).repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "member")
    return dealt.mapInArrow(_solve(width, k), FOUND)


def topk(vectors: DataFrame, queries: Column, k: int = 5, report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query with the others.

    ``vectors`` has vec_id and embedding; ``queries`` says which rows ask. Each component x becomes
    floor(256 x), x as double. A query is held against every row but its own, so rows that repeat its
    vec_id are candidates, and each of several rows with a vec_id that asks gets its own k. Ties go to
    the smaller vec_id; a null one never asks by its id and comes last. Vectors that are null or hold null or non-finite
    components take no part. Vectors of unequal length are compared as if filled up with zeros. A score
    that 64 bits don't hold is the nearest that they do. A query with fewer than k others gets them all.
    Other columns are ignored; an empty table gives no rows.

    The pivots are the rows whose numbers hash lowest; they steer only what is moved where, and the
    result is exact. ``report`` takes pairs (chunks times query groups) and sent (how many were needed).
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", F.coalesce(queries, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("x"))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "asks", "x"), "vectors")
    n, asking, widest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x"))).first()
    if not n or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(widest, 1)
    most = max(1, min(math.isqrt(n), PIVOT_BYTES // (8 * width)))
    sample = [r["x"] for r in rows.orderBy(F.xxhash64("rid"), "rid").limit(most).collect()]
    pivots = np.unique(quantised(np.array([x + [0.0] * (width - len(x)) for x in sample])), axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))]
    coarse = max(1, min(len(pivots), asking // QUERIES))

    homes = stage(rows.mapInArrow(_homes(pivots, coarse), HOMES), "homes")
    groups = homes.groupBy("pivot").agg(F.max("near").alias("radius"), F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    radius = np.full(len(pivots), -1.0)
    for r in groups.collect():  # a row for each pivot
        radius[r["pivot"]] = r["radius"] if math.isfinite(r["radius"]) else np.inf
    split = homes.join(groups.select("pivot", "parts"), "pivot").withColumn("part", F.pmod(F.xxhash64("rid"), "parts").cast("int"))
    dealt = split.select("pivot", "part", "rid", "vec_id", "v", "near").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "near").drop("near")
    chunks = stage(dealt.mapInArrow(_chunks(width), CHUNKS), "chunks")
    spread = max(1, -(-chunks.count() // SLICE))

    def blocks(asked: DataFrame, by: str) -> DataFrame:
        n_blocks = asked.groupBy(F.col(by).alias("grp")).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        return asked.withColumnRenamed(by, "grp").join(n_blocks, "grp").withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))

    asked = homes.where("asks").select("pivot", "coarse", "rid", "vec_id", F.lit(None).cast("long").alias("theta"), "v")
    near = blocks(asked, "pivot").select("grp", "block", "rid", "vec_id", "theta", "v")
    at_home = near.select("grp", "block", F.col("grp").alias("pivot")).distinct()
    first = _solved(near, chunks.where("first"), at_home, 1, width, k)
    theta = first.groupBy(F.col("rid").alias("of")).agg(F.min("score").alias("theta"), F.count("*").alias("c")).where(F.col("c") >= k).select("of", "theta")
    asked = blocks(asked.drop("theta").join(theta, F.col("rid") == F.col("of"), "left"), "coarse")
    asked = stage(asked.select("grp", "block", "rid", "vec_id", "theta", "v"), "asked")
    ordered = asked.repartition("grp", "block").sortWithinPartitions("grp", "block").select("grp", "block", F.col("theta").cast("double"), "v")
    needs = stage(ordered.mapInArrow(_needs(pivots, radius), "grp int, block int, pivot int").distinct(), "needs")
    if report is not None:
        report["pairs"] = chunks.count() * asked.select("grp", "block").distinct().count()
        report["sent"] = needs.join(chunks.select("pivot"), "pivot").count()

    best = _solved(asked, chunks, needs, spread, width, k)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
