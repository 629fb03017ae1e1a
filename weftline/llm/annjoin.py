"""Near-duplicate vectors by range search in robust-pruned flat graphs.

Vectors of a label are dealt to overlapping clusters in two steps: to several nearest cells, and in
each to the nearest of its clusters, so that clusters stay small however many vectors there are.
A cluster is dealt to shards of bounded size. A shard builds a flat graph of its vectors by robust
pruning; a vector's adjacency lists from all its shards are united. A query starts at a shard's
medoids, moves greedily by a beam, and keeps expanding whatever lies within the search range, which is
wider than the linking threshold. What it meets is verified by its cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.components import connected_components
from weftline.staging import stage

THRESHOLD = 0.93
SLACK = 0.08  # how far below the threshold a node is still expanded
DEGREE = 16
LONG = 4  # further edges to any members, so that tight groups larger than a list stay joined
CANDIDATES = 64
ALPHA = 1.2
BEAM = 8
STARTS = 32  # members, the medoid first, of which the nearest is where a search starts
OVERLAP = 3  # cells of a vector, and one more for each time that clusters double beyond SPARSE
SPARSE = 64
SHARD = 1000  # vectors a shard holds at most, about
PART = 20_000  # vectors that one task assigns to the centroids of a cell
STEP = 4  # nodes that a query expands at once
QUERY_BLOCK = 500
BLOCK = 8192  # vectors of a part when all pairs are compared, about
COMPARED = 256  # of which so many meet the other part's at once


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares of very small or large components hold
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each of the unit vectors x, -1 where a list is shorter: of the nearest candidates,
    the nearest one stays and those that it is ``alpha`` times closer to than the node are dropped, again and again."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1)
    d = np.sqrt(np.maximum(0.0, 2 - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    c = min(CANDIDATES, n - 1)
    near = np.argpartition(d, c - 1, axis=1)[:, :c]
    own = np.take_along_axis(d, near, 1)
    order = np.argsort(own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    alive = np.isfinite(own)
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        best = near[rows, at]
        out[some, k] = best[some]
        alive[rows, at] = False
        alive &= alpha * d[best[:, None], near] > own
    far = np.random.default_rng(n).integers(0, n, (n, LONG))
    return np.hstack([out, np.where(far == rows[:, None], -1, far)])


def range_search(x: np.ndarray, adjacency: np.ndarray, starts: np.ndarray, q: np.ndarray, reach: float, threshold: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of what the searches of all q met in the graph of x with a cosine of the threshold or more.

    A search starts at the nearest of the starts, and at the query's own node where ``own`` is not -1. It
    expands its nearest nodes not yet expanded, as long as they are among the beam's best or in reach.
    """
    nq = len(q)
    seen = np.zeros((nq, len(x)), bool)
    top = np.full((nq, beam), -np.inf)
    begin = starts[(q @ x[starts].T).argmax(1)]
    who, node = np.arange(nq), begin
    if own is not None:
        inside = np.flatnonzero((own >= 0) & (own != begin))
        who, node = np.concatenate([who, inside]), np.concatenate([node, own[inside]])
    waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    found = []
    while len(who) or len(waiting[0]):
        seen[who, node] = True
        cosine = np.einsum("ij,ij->i", q[who], x[node])
        hit = cosine >= threshold
        found.append((who[hit], node[hit]))
        if len(who):
            # The beam's best of each query that met something.
            order = np.lexsort((-cosine, who))
            who, node, cosine = who[order], node[order], cosine[order]
            some, first = np.unique(who, return_index=True)
            place = np.arange(len(who)) - np.repeat(first, np.diff([*first, len(who)]))
            few = place < beam
            fresh = np.full((len(some), beam), -np.inf)
            fresh[np.searchsorted(some, who[few]), place[few]] = cosine[few]
            top[some] = np.partition(np.hstack([top[some], fresh]), beam, axis=1)[:, beam:]
        floor = np.minimum(top.min(1), reach)
        who, node, cosine = (np.concatenate(p) for p in zip(waiting, (who, node, cosine), strict=True))
        good = cosine >= floor[who]  # a floor never falls, so the others are done
        who, node, cosine = who[good], node[good], cosine[good]
        order = np.lexsort((-cosine, who))
        who, node, cosine = who[order], node[order], cosine[order]
        now = np.arange(len(who)) - np.searchsorted(who, who) < STEP
        waiting = (who[~now], node[~now], cosine[~now])
        to = adjacency[node[now]]
        who, to = np.repeat(who[now], to.shape[1]), to.ravel()
        new = (to >= 0) & ~seen[who, to]
        pairs = np.unique(who[new] * len(x) + to[new])
        who, node = pairs // len(x), pairs % len(x)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def apart(c: np.ndarray, most: float) -> list[int]:
    """Those that are no closer than ``most`` to an earlier one, so that a tight group has one centroid and not many."""
    kept, at = np.empty_like(c), []
    for i, row in enumerate(c):
        if not at or (kept[: len(at)] @ row).max() < most:
            kept[len(at)] = row
            at.append(i)
    return at


def _units(batches):
    """Vectors as unit vectors in double precision."""
    for batch in batches:
        v = [unit(np.array([e]))[0].tobytes() for e in batch[3].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(v, pa.binary())], names=["node", "m", "key", "v"])


def _nearest(most: float):
    """Each key's centroids come first and are held; each point gets its nearest ones."""
    schema = pa.schema([("node", pa.int64()), ("m", pa.int64()), ("v", pa.binary()), ("to", pa.list_(pa.int64())), ("cosine", pa.list_(pa.float64()))])

    def run(batches):
        key, held, c, points = None, [], None, []

        def flush():
            nonlocal c
            if c is None:
                x = np.stack([np.frombuffer(v) for _, v in held])
                keep = apart(x, most)
                c = x[keep], np.array([n for n, _ in held])[keep]
            s = np.stack([np.frombuffer(p[2]) for p in points]) @ c[0].T
            n = min(points[0][3], s.shape[1])
            order = np.argsort(-s, axis=1, kind="stable")[:, :n]
            out = pa.RecordBatch.from_arrays([*(pa.array([p[i] for p in points], f.type) for i, f in enumerate(list(schema)[:3])), pa.array(list(c[1][order]), pa.list_(pa.int64())), pa.array(list(np.take_along_axis(s, order, 1)), pa.list_(pa.float64()))], schema=schema)
            points.clear()
            return out

        for batch in batches:
            for k, part, point, node, m, v, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, part) != key:
                    if points:
                        yield flush()
                    key, held, c = (k, part), [], None
                if point:
                    points.append((node, m, v, top))
                    if len(points) >= 1000:
                        yield flush()
                else:
                    held.append((node, v))
        if points:
            yield flush()

    return run


def assigned(points: DataFrame, centroids: Column, top: Column, most: float) -> DataFrame:
    """Points (key, node, m, v, shares) with the nearest of their key's centroids: ``to`` and ``cosine``, nearest first.

    ``centroids`` and ``top`` say, from the ``n`` points of a key and their shares, how many
    centroids are drawn from them, by their hash, and how many a point gets. Centroids closer than
    ``most`` to another one are left out.
    """
    counts = points.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("shares").alias("shares"))
    counts = counts.select("key", "n", "least", centroids.alias("k"), top.cast("int").alias("most"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = points.select("key", "node", "m", "v").join(counts, "key")
    drawn = (F.pmod(F.xxhash64("node", "key"), F.lit(1 << 40)) < F.col("k") / F.col("n") * float(1 << 40)) | (F.col("node") == F.col("least"))
    c = rows.where(drawn).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("point"), "node", "m", "v", "most")
    p = rows.select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(True).alias("point"), "node", "m", "v", "most")
    dealt = c.unionByName(p).repartition("key", "part").sortWithinPartitions("key", "part", "point", "node")
    return dealt.mapInArrow(_nearest(most), "node long, m long, v binary, to array<long>, cosine array<double>")


def _groups(batches):
    """Rows of one shard, gathered by its key in the first two columns; a shard is bounded."""
    key, rows = None, []
    for batch in batches:
        for cluster, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (cluster, part) != key:
                if rows:
                    yield key, rows
                key, rows = (cluster, part), []
            rows.append(row)
    if rows:
        yield key, rows


def _build():
    schema = pa.schema([("node", pa.int64()), ("to", pa.list_(pa.int64()))])

    def run(batches):
        for _, rows in _groups(batches):
            nodes, x = np.array([r[0] for r in rows]), np.stack([np.frombuffer(r[1]) for r in rows])
            out = [nodes[a[a >= 0]] for a in robust_prune(x)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(out, pa.list_(pa.int64()))], schema=schema)

    return run


def earlier(homes: list[list[int]], cluster: int, none: int) -> np.ndarray:
    """A row for each vector: those of its clusters that come before this one, filled up with ``none``.

    Clusters are hashes, so that ``none`` is not one of them but by a chance of 2^-63.
    """
    rows = [[c for c in h if c < cluster] for h in homes]
    out = np.full((len(rows), max(1, max(map(len, rows)))), none)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _search(threshold: float):
    """Members of a shard come first, then all vectors of its cluster as queries."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    class Shard:
        def __init__(self, key):
            self.key, self.members, self.x = key, [], None

        def close(self):
            nodes = np.array([r[1] for r in self.members])
            self.x, self.m = np.stack([np.frombuffer(r[2]) for r in self.members]), np.array([r[3] for r in self.members])
            self.nodes = nodes
            self.homes = earlier([r[4] for r in self.members], self.key[0], -1)
            self.place = place = {node: i for i, node in enumerate(nodes.tolist())}
            lists = [[place[t] for t in r[5] if t in place and place[t] != i] for i, r in enumerate(self.members)]
            # Edges run both ways, so that no member is without a way in.
            both = [set(a) for a in lists]
            for i, a in enumerate(lists):
                for t in a:
                    both[t].add(i)
            width = max(1, max(map(len, both)))
            self.adjacency = np.full((len(both), width), -1)
            for i, a in enumerate(both):
                self.adjacency[i, : len(a)] = sorted(a)
            medoid = int((self.x @ self.x.mean(0)).argmax())
            self.starts = np.unique([medoid, *range(0, len(nodes), max(1, len(nodes) // STARTS))])
            self.root: dict = {}

        def find(self, v):
            while (up := self.root.get(v, v)) != v:
                self.root[v] = self.root.get(up, up)
                v = up
            return v

        def links(self, rows):
            q = np.stack([np.frombuffer(r[2]) for r in rows])
            a, b = range_search(self.x, self.adjacency, self.starts, q, threshold - SLACK, threshold, own=np.array([self.place.get(r[1], -1) for r in rows]))
            ids = np.array([r[1] for r in rows])
            other = ids[a] != self.nodes[b]
            a, b = a[other], b[other]
            # A pair that shares several clusters is counted in the first of them.
            homes, count, out = earlier([r[4] for r in rows], self.key[0], -2), np.zeros(len(rows), np.int64), []
            for at in range(0, len(a), 1 << 16):
                i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                first = ~(homes[i][:, :, None] == self.homes[j][:, None, :]).any((1, 2))
                np.add.at(count, i[first], self.m[j[first]])
            # Links that join what the block's pairs join: each node with the least of its component.
            names, ends = np.unique(np.concatenate([ids[a], self.nodes[b]]), return_inverse=True)
            least, ends = np.arange(len(names)), ends.reshape(2, -1)
            while True:
                new = least.copy()
                np.minimum.at(new, ends[0], least[ends[1]])
                np.minimum.at(new, ends[1], new[ends[0]])
                new = new[new]
                if (new == least).all():
                    break
                least = new
            for x, y in zip(names.tolist(), names[least].tolist(), strict=True):
                u, v = self.find(x), self.find(y)
                if u != v:
                    self.root[u] = v
                    out.append((x, y, 0))
            out.extend((r[1], None, c) for r, c in zip(rows, count.tolist(), strict=True) if c)
            return out

    def run(batches):
        shard, waiting = None, []

        def flush():
            if shard is None or not waiting:
                return None
            if shard.x is None:
                shard.close()
            out = shard.links(waiting)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=schema)

        for batch in batches:
            for cluster, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None or shard.key != (cluster, part):
                    if (out := flush()) is not None:
                        yield out
                    shard = Shard((cluster, part))
                if not row[0]:
                    shard.members.append(row)
                else:
                    waiting.append(row)
                    if len(waiting) >= QUERY_BLOCK and (out := flush()) is not None:
                        yield out
        if (out := flush()) is not None:
            yield out

    return run


def _compare(threshold: float):
    """(a, b, links) as ``_search`` gives it, of all pairs of two parts of a label, or within one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes, m, part = (rows.column(c).to_numpy() for c in ("node", "m", "part"))
        lowest, one = rows.column("i")[0].as_py(), rows.column("i")[0] == rows.column("j")[0]
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(values := rows.column("v").to_pylist()):
            by_size.setdefault(len(v), []).append(i)
        least, count = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for at in by_size.values():
            at, x = np.array(at), np.frombuffer(b"".join(values[i] for i in at)).reshape(len(at), -1)
            own = part[at] == lowest
            left, right = (np.arange(len(at)),) * 2 if one else (np.flatnonzero(own), np.flatnonzero(~own))
            for first in range(0, len(left), COMPARED):
                a = left[first : first + COMPARED]
                i, j = np.nonzero(x[a] @ x[right].T >= threshold - 1e-9)
                for k in range(0, len(i), 1 << 16):
                    p, q = a[i[k : k + (1 << 16)]], right[j[k : k + (1 << 16)]]
                    hit = (np.einsum("ij,ij->i", x[p], x[q]) >= threshold) & (p != q)
                    p, q = at[p[hit]], at[q[hit]]
                    np.add.at(count, p, m[q])
                    if not one:
                        np.add.at(count, q, m[p])
                    while (least[p] != least[q]).any():
                        low = np.minimum(least[p], least[q])
                        for end in (p, q):
                            np.minimum.at(least, least[end], low)
                            np.minimum.at(least, end, low)
                        while (least != least[least]).any():
                            least = least[least]
        some, moved = np.flatnonzero(count), np.flatnonzero(least != np.arange(len(nodes)))
        links = pa.nulls(len(some), pa.int64())
        return pa.concat_tables([pa.table({"a": nodes[some], "b": links, "links": count[some]}), pa.table({"a": nodes[moved], "b": nodes[least[moved]], "links": np.zeros(len(moved), np.int64)})])

    return run


def _all_pairs(units: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) of all pairs of a label: its vectors are dealt to parts of about ``BLOCK``, and each two parts meet in one task."""
    counts = units.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = units.join(counts, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "node", "m", "v")
    return met.groupBy("key", "i", "j").applyInArrow(_compare(threshold), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least the threshold. n_links counts the other rows that a row links with;
    component_id is the smallest vec_id that links reach; kept says that it is the row's own.

    Search is approximate: a pair may be missed, none below the threshold is reported; ``audit`` measures
    recall. With ``exact`` all pairs of a label are compared after it, in blocks: work that grows with the square of a label,
    in memory that doesn't. Vectors that are null, zero, or hold null or non-finite components, and rows with a null
    label, link with nothing; nor do vectors of unequal length. Equal vectors of a label are one node
    that counts as often as it occurs, so copies cost nothing. A null vec_id gets its component's
    smallest id, null if there is none, and is not kept. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label").withColumn("node", F.when(F.col("label").isNotNull() & usable(F.col("embedding")), F.xxhash64("label", "embedding")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.xxhash64(F.min("label"), F.size(F.min("embedding"))).alias("key"), F.min("embedding").alias("embedding"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    nodes = stage(nodes, "nodes")
    units = stage(nodes.select("node", "m", "key", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_units, "node long, m long, key long, v binary"), "units")

    rate = 2 * OVERLAP / SHARD  # clusters of a label for each of its vectors
    near = threshold - SLACK
    overlap = F.lit(OVERLAP) + F.floor(F.log2(1 + F.col("n") * rate / SPARSE))
    points = units.withColumn("shares", F.lit(1))
    cells = assigned(points, F.ceil(F.sqrt(F.col("n") * rate)), overlap, near)
    cells = stage(cells.select("node", "m", "v", F.size("to").alias("shares"), F.explode("to").alias("key")), "cells")
    # In every cell its nearest cluster, so that two vectors that share a cell, though not all, can meet there.
    chosen = assigned(cells, F.ceil(F.col("n") * rate / F.col("shares")), F.lit(1), near)
    homes = stage(chosen.groupBy("node").agg(F.first("m").alias("m"), F.first("v").alias("v"), F.array_distinct(F.flatten(F.collect_list("to"))).alias("clusters")), "homes")

    each = homes.select("node", "m", "v", "clusters", F.explode("clusters").alias("cluster"))
    counts = each.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    members = each.join(counts, "cluster").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))

    built = members.select("cluster", "part", "node", "v").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "node").mapInArrow(_build(), "node long, to array<long>")
    united = stage(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "graph")

    graph = members.join(united, "node").select("cluster", "part", F.lit(False).alias("asks"), "node", "v", "m", "clusters", "to")
    asks = each.join(counts, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "node", "v", "m", "clusters", F.lit(None).cast("array<long>").alias("to"))
    dealt = graph.unionByName(asks).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "asks", "node")
    found = dealt.mapInArrow(_search(threshold), "a long, b long, links long")
    found = stage(found.where("b is not null").unionByName(_all_pairs(units, threshold)) if exact else found, "found")

    linked = connected_components(found.where("b is not null"), "a", "b").select("node", "component")
    degree = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(lowest, "component").join(degree.withColumnRenamed("a", "node"), "node", "left")
    known = known.select(F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.join(known, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, sample: int = 200, threshold: float = THRESHOLD) -> float:
    """Recall of n_links over the ``sample`` vectors whose ids hash lowest, against all their label's vectors."""
    good = vectors.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    asked = good.orderBy(F.xxhash64("vec_id")).limit(sample).select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"), "label")
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
    pairs = good.join(F.broadcast(asked), "label").where("vec_id != q and size(e) = size(embedding)").where(F.expr(f"{dot('e', 'embedding')} / sqrt({dot('e', 'e')} * {dot('embedding', 'embedding')}) >= {threshold}"))
    true = pairs.groupBy("q").agg(F.count("*").alias("n"))
    got, all_ = true.join(result, F.col("q") == F.col("vec_id")).agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return got / all_ if all_ else 1.0
