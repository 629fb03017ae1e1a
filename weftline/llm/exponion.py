"""Centroid clustering in exact integers, with Exponion search.

Each vector keeps an upper bound of its distance to its centroid and a lower bound of that to any other.
Bounds move with the centroids; where they don't settle the matter, only centroids in a ball around the vector's
own are looked at: twice the distance and the way to the nearest other centroid, both included. They are
the head of a list of the other centroids by their distance from that one. Whatever is left out is
farther away, never equally near, so ties are seen and go to the smaller number.

Bounds are recomputed from the few centroid sets so far rather than written next to every vector: a round reads the
vectors once and writes nothing but sums. After ``HELD`` rounds they are written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.staging import stage, unstage

SCALE = 64
HELD = 4  # rounds that are worked out anew before bounds are written
SLICE = 4096  # vectors that are compared at once
SMALL = 1 << 22  # components up to which sums of squares of 64 differences are exact in doubles
LIMB = 32
MOST = (1 << 63) - 1
NEAR = 1e-12  # far more than rounding can move a bound, relatively


def integers(values: np.ndarray) -> list[list[int]]:
    """floor(SCALE * x) of finite doubles, of any size."""
    return [[int(np.floor(x * SCALE)) if abs(x) < 1 << 50 else int(x) * SCALE for x in row] for row in values.tolist()]


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(vector: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """(number, squared distance) of the nearest centroid by looking at all of them in exact integers."""
    d, c = min((squared(vector, c), i) for i, c in enumerate(centroids))
    return c, d


class Layout:
    """Where centroids are to one another, with distances rounded so that a ball is never too small."""

    def __init__(self, centroids: list[list[int]], before: Layout | None):
        self.points = np.array(centroids, np.float64)
        self.norms = (self.points**2).sum(1)
        k = len(centroids)
        apart = np.sqrt(self.between(self.points, np.arange(k)))
        np.fill_diagonal(apart, np.inf)
        self.others = np.argsort(apart, axis=1, kind="stable")[:, : k - 1]
        self.ways = np.take_along_axis(apart, self.others, 1) * (1 - NEAR)
        self.next = self.ways[:, 0] if k > 1 else np.full(k, np.inf)
        if before is not None:
            moved = np.sqrt(((self.points - before.points) ** 2).sum(1)) * (1 + NEAR)
            order = np.argsort(moved)
            self.moved, self.others_moved = moved, np.full(k, moved[order[-1]])
            self.others_moved[order[-1]] = moved[order[-2]] if k > 1 else 0.0

    def between(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances of each row to the centroids ``of``; whole numbers, exact while components are at most SMALL."""
        return (x**2).sum(1)[:, None] - 2 * (x @ self.points[of].T) + self.norms[of]

    def own(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return ((x - self.points[of]) ** 2).sum(1)


class Bounds:
    """Of each vector: its centroid, the most it may be from it and the least from all others; ``looked`` counts centroids compared."""

    def __init__(self, n: int):
        self.of, self.upper, self.lower, self.looked = np.full(n, -1), np.full(n, np.inf), np.full(n, -np.inf), 0

    def look(self, layout: Layout, x: np.ndarray, rows: np.ndarray, among: np.ndarray) -> None:
        """Compare rows with the centroids ``among``, which come by number, so the first of equally near ones is taken."""
        d = layout.between(x[rows], among)
        self.looked += d.size
        best = d.argmin(1)
        self.of[rows] = among[best]
        self.upper[rows] = np.sqrt(np.take_along_axis(d, best[:, None], 1)[:, 0]) * (1 + NEAR)
        np.put_along_axis(d, best[:, None], np.inf, 1)
        self.lower[rows] = np.sqrt(d.min(1)) * (1 - NEAR)

    def first(self, layout: Layout, x: np.ndarray) -> None:
        if len(x):
            self.look(layout, x, np.arange(len(x)), np.arange(len(layout.points)))

    def settled(self, layout: Layout, rows: np.ndarray) -> np.ndarray:
        """Whether a row's centroid is nearer than any other, without a tie."""
        return self.upper[rows] < np.maximum(self.lower[rows], layout.next[self.of[rows]] / 2)

    def again(self, layout: Layout, x: np.ndarray) -> None:
        """After the centroids have moved."""
        self.upper = (self.upper + layout.moved[self.of]) * (1 + NEAR)
        moved = layout.others_moved[self.of]
        self.lower = self.lower - moved - NEAR * (np.abs(self.lower) + moved)
        rows = np.flatnonzero(~self.settled(layout, np.arange(len(x))))
        self.upper[rows] = np.sqrt(layout.own(x[rows], self.of[rows])) * (1 + NEAR)
        self.looked += len(rows)
        rows = rows[~self.settled(layout, rows)]
        for c in np.unique(self.of[rows]):
            mine = rows[self.of[rows] == c]
            reach = (2 * self.upper[mine] + layout.next[c] * (1 + 4 * NEAR)) * (1 + NEAR)
            inside = np.searchsorted(layout.ways[c], reach, side="right")
            # Rows whose balls hold up to the same power of two of centroids look at the same ones.
            rings = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int), len(layout.points) - 1)
            for ring in np.unique(rings):
                self.look(layout, x, mine[rings == ring], np.sort(np.append(layout.others[c, :ring], c)))


def assign(x: np.ndarray, history: list[list[list[int]]], held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[Bounds, Layout]:
    """Bounds of small vectors after all centroid sets of ``history``; ``held``: bounds after the first of them."""
    layout, bounds = Layout(history[0], None), Bounds(len(x))
    if held is None:
        bounds.first(layout, x)
    else:
        bounds.of, bounds.upper, bounds.lower = held
    for centroids in history[1:]:
        layout = Layout(centroids, layout)
        if len(x) and len(centroids) > 1:
            bounds.again(layout, x)
    return bounds, layout


def _judged(history: list[list[list[int]]], dim: int):
    """For each slice of a batch: its columns, vectors scaled, (cluster, squared distance or None) and bounds of small ones, and which ones are small."""
    plain = any(abs(v) > SMALL for centroids in history for c in centroids for v in c)

    def each(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                raw = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    x = np.floor(raw * SCALE)
                small = np.zeros(len(x), bool) if plain else (np.abs(x) <= SMALL).all(1)
                held = None
                if "upper" in part.schema.names:
                    held = tuple(part.column(n).to_numpy(zero_copy_only=False)[small].copy() for n in ("cluster", "upper", "lower"))
                # Centroids that doubles don't hold exactly are compared one by one, so there is nothing to bound.
                yield part, raw, x, small, *((Bounds(0), None) if plain else assign(x[small], history, held))

    return each


def _sums(history, dim: int):
    """Of each task: how many vectors each cluster has and the sum of each component, in limbs."""

    def run(batches):
        k = len(history[-1])
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        for _, raw, x, small, bounds, _ in _judged(history, dim)(batches):
            of, mine = bounds.of, x[small].astype(np.int64)
            for c in np.unique(of):
                counts[c] += int((of == c).sum())
                sums[c] = [a + b for a, b in zip(sums[c], mine[of == c].sum(0).tolist(), strict=True)]
            for vector in integers(raw[~small]):
                c, _ = nearest(vector, history[-1])
                counts[c] += 1
                sums[c] = [a + b for a, b in zip(sums[c], vector, strict=True)]
        out = [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        for c, row in enumerate(sums):
            for place, value in enumerate(row):
                left, limb = abs(value), 0
                while left:
                    part = left & ((1 << LIMB) - 1)
                    out.append((c, place, limb, part if value > 0 else -part))
                    left, limb = left >> LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "value"])

    return run


def _assigned(history, dim: int):
    """vec_id, cluster and squared distance, held at 64 bits."""

    def run(batches):
        for part, raw, x, small, bounds, layout in _judged(history, dim)(batches):
            cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
            if layout is not None:
                cluster[small], distance[small] = bounds.of, layout.own(x[small], bounds.of).astype(np.int64)
            for i, vector in zip(np.flatnonzero(~small), integers(raw[~small]), strict=True):
                c, d = nearest(vector, history[-1])
                cluster[i], distance[i] = c, min(d, MOST)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _carried(history, dim: int):
    """Vectors with their bounds."""

    def run(batches):
        for part, _, x, small, bounds, _ in _judged(history, dim)(batches):
            of, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf)
            of[small], upper[small], lower[small] = bounds.of, bounds.upper, bounds.lower
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(of), pa.array(upper), pa.array(lower)], names=["vec_id", "embedding", "cluster", "upper", "lower"])

    return run


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``(vec_id, embedding)`` of vectors with exactly ``dim`` components, none null or non-finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, held: int = HELD) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of vectors (vec_id, embedding).

    Only vectors with exactly ``dim`` components, none null or non-finite, take part; a component is
    floor(64 * x). The first centroids are those whose sha256 of ``1:<vec_id>`` is smallest: null ids last, ties by
    components; all, if there are fewer than ``k``. Each round assigns every vector to the nearest centroid (ties:
    the smaller number) and makes each centroid that has vectors their floored mean. Then vectors are assigned once more.
    Repeated rows count each; distances and sums beyond 64 bits are held at their end; other columns are ignored; an
    empty table gives no rows. The driver gets ``k`` centroids a round. ``k`` times ``dim`` has to fit in a task.
    """
    rows, spark = whole_vectors(vectors, dim), vectors.sparkSession
    order = [F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("embedding")]
    start = rows.orderBy(*order).limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    history, kept = [integers(np.array([r["embedding"] for r in start], np.float64))], None
    for _ in range(rounds):
        found = rows.mapInArrow(_sums(history, dim), "cluster int, place int, limb int, value long").groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect()
        count = {r["cluster"]: r["value"] for r in found if r["place"] < 0}
        sums: dict[tuple[int, int], int] = {}
        for r in found:
            if r["place"] >= 0:
                key = (r["cluster"], r["place"])
                sums[key] = sums.get(key, 0) + (r["value"] << LIMB * r["limb"])
        history = [*history, [[sums.get((c, j), 0) // count[c] for j in range(dim)] if c in count else old for c, old in enumerate(history[-1])]]
        if len(history) > held:
            carried = T.StructType([*rows.schema.fields[:2], T.StructField("cluster", T.LongType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])
            rows, old = stage(rows.mapInArrow(_carried(history[:-1], dim), carried), "bounds"), kept
            history, kept = history[-2:], rows
            if old is not None:
                unstage(old)
    out = stage(rows.mapInArrow(_assigned(history, dim), schema), "clusters")
    total = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(MOST, int(sum(total.values())))
    ends = [(c, min(MOST, int(d)), whole, hashlib.sha256(",".join(map(str, history[-1][c])).encode()).hexdigest()) for c, d in total.items()]
    ends = spark.createDataFrame(ends, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(ends), F.col("cluster") == F.col("of")).drop("of")
