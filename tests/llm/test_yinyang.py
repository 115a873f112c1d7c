"""Yinyang bounds against plain rounds over all centroids, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from floorgraph.llm import yinyang


def plain(vectors, k, rounds, dim, scale=1024, seed=3):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in kept:
            held[near(v)[1]].append(v)
        centroids = [[sum(column) // len(h) for column in zip(*h, strict=True)] if h else c for h, c in zip(held, centroids, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    sums = {j: sum(d for _, d, c in out if c == j) for j in range(len(centroids))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], sum(sums.values()), name[j]) for i, d, j in out), key=str)


def cases(rng, n, dim):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, [float(rng.randrange(-2, 3)) for _ in range(dim)]) for i in range(60)]  # many ties
    hot = [0.25] * dim
    rows += [(2 * n + i, hot) for i in range(80)] + [(7, hot), (7, hot), (None, hot), (None, [0.5] * dim)]
    return rows + [(900_001, None), (900_002, []), (900_003, [1.0]), (900_004, [float("nan")] * dim), (900_005, [None, *[1.0] * (dim - 1)]), (900_006, [float("inf")] * dim)]


@pytest.mark.parametrize(("k", "groups", "rounds"), [(8, None, 10), (12, 4, 3), (1, None, 2), (500, 5, 1)])
def test_equals_plain_rounds(spark, k, groups, rounds):
    rows = cases(random.Random(k), 150, 5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, keyed string")
    out = yinyang.cluster(df, k=k, rounds=rounds, dim=5, n_groups=groups).collect()
    assert sorted((tuple(r) for r in out), key=str) == plain(rows, k, rounds, 5)


def test_large_components_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [3e5 * (i % 3), 1e6 * (i % 2), -7.5]) for i in range(40)]
    out = yinyang.cluster(spark.createDataFrame(rows, schema), k=4, rounds=3, dim=3).collect()
    assert sorted((tuple(r) for r in out), key=str) == plain(rows, 4, 3, 3)
    assert yinyang.cluster(spark.createDataFrame([], schema), dim=3).count() == 0
    assert yinyang.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema), dim=3).count() == 0
    with pytest.raises(Exception, match="does not fit a long"):
        yinyang.cluster(spark.createDataFrame([(1, [0.0]), (2, [1e8]), (3, [2e9])], schema), k=1, rounds=1, dim=1).collect()


def test_filters_spare_most_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (40, 16))
    v = (centres[rng.integers(0, 40, 3000)] + rng.integers(-200, 200, (3000, 16))).astype(np.int64)
    groups = yinyang.centroid_groups(centres, 4)
    cluster, upper, lower, first = yinyang.Model(centres, groups, None).assign(v, np.zeros(0, int), np.zeros(0), np.zeros((0, 4)))
    moved = centres + rng.integers(-3, 4, centres.shape)
    again, upper, lower, second = yinyang.Model(moved, groups, centres).assign(v, cluster, upper, lower)
    exact = yinyang.squared(v, moved)
    assert (again == exact.argmin(axis=1)).all() and first >= v.shape[0] * 40 and second < first / 20
    others = np.where(np.arange(40)[None, :] == again[:, None], np.inf, np.sqrt(exact))
    assert all((lower[:, g] <= others[:, groups == g].min(axis=1) + 1e-6).all() for g in range(4)) and (upper + 1e-6 >= np.sqrt(exact.min(axis=1))).all()
