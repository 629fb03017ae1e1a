"""Exponion clustering against plain rounds in exact integers."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import exponion

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(data, k, rounds, dim):
    rows = [(i, [math.floor(x * 64) if abs(x) < 2**50 else int(x) * 64 for x in v]) for i, v, _ in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in start[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        of = [j for _, j in assigned()]
        for j in set(of):
            mine = [v for (_, v), o in zip(rows, of, strict=True) if o == j]
            centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assigned()
    most = 2**63 - 1
    per = collections.Counter()
    for d, j in found:
        per[j] += min(d, most)
    whole = min(most, sum(per.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, min(d, most), min(most, per[j]), whole, sha[j]) for (i, _), (d, j) in zip(rows, found, strict=True))


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("cluster", "upper", "lower", "distance", "of")}).repartition(5)


def got(df, **how):
    return collections.Counter(tuple(r) for r in exponion.cluster(df, **how).collect())


def clumps(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dim)) * 3
    return [(i, (middles[i % 9] + rng.normal(size=dim) * 0.2).tolist(), i % 4) for i in range(n)]


def odd(dim):
    base = clumps(120, dim)
    bad = [(200, None, 0), (201, [1.0] * (dim - 1), 0), (202, [float("nan")] + [0.0] * (dim - 1), 0), (203, [None] + [0.0] * (dim - 1), 0), (204, [float("-inf")] * dim, 0), (205, [], 0), (206, [0.0] * dim, None)]
    return [*base, *bad, (None, base[3][1], 0), base[5], base[5], *[(300 + i, base[7][1], 0) for i in range(40)]]


@pytest.mark.parametrize("k,rounds,dim,held", [(16, 3, 8, 4), (5, 7, 8, 2), (1, 3, 8, 4), (40, 4, 2, 1), (16, 0, 8, 4), (400, 2, 8, 4)])
def test_clusters_against_plain_rounds(spark, k, rounds, dim, held):
    data = odd(dim)
    assert got(frame(spark, data), k=k, rounds=rounds, dim=dim, held=held) == plain(data, k, rounds, dim)


def test_ties_go_to_the_smaller_number(spark):
    """Points on a coarse grid, so that very many are equally near to several centroids."""
    rng = np.random.default_rng(4)
    data = [(i, (rng.integers(-3, 4, 2) / 16).tolist(), 0) for i in range(400)]
    for k in (4, 12, 30):
        assert got(frame(spark, data), k=k, rounds=5, dim=2, held=2) == plain(data, k, 5, 2)


@pytest.mark.parametrize("large", [1e5, 3e8, 1e30, 1.7e308])
def test_large_components_stay_exact(spark, large):
    data = [*clumps(60, 4), *[(500 + i, [large * (i + 1) / 7, -large, 1.0, 0.1], 0) for i in range(6)]]
    assert got(frame(spark, data), k=7, rounds=3, dim=4, held=2) == plain(data, 7, 3, 4)


def test_few_or_no_vectors(spark):
    data = clumps(3, 4)
    assert got(frame(spark, data), dim=4) == plain(data, 16, 3, 4)
    empty = exponion.cluster(frame(spark, data).limit(0), dim=4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_balls_leave_most_centroids_out():
    """On clumps fewer distances are worked out than all by all, and every assignment is that of a full look."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-20_000, 20_000, (64, 16))
    x = (middles[rng.integers(0, 64, 3000)] + rng.integers(-300, 300, (3000, 16))).astype(float)
    history = [x[:64].astype(int).tolist()]
    full = 0
    for _ in range(6):
        bounds, layout = exponion.assign(x, history)
        d = layout.between(x, np.arange(64))
        assert (bounds.of == d.argmin(1)).all()
        full += d.size
        history.append([(x[bounds.of == c].sum(0) // max(1, (bounds.of == c).sum())).astype(int).tolist() if (bounds.of == c).any() else history[-1][c] for c in range(64)])
    assert bounds.looked < 0.5 * full
