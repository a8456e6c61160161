"""Centroid clustering against the definition in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from nightloom.llm.centroids import LARGEST, LONG, cluster_vectors, nearest


def plain(rows, clusters=8, rounds=10, dims=64):
    kept = [(k, [max(-LARGEST, min(LARGEST, math.floor(1024 * x))) for x in v]) for k, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)[:clusters]
    cents = [v for _, v in seeds]
    if not cents:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        for i, vs in of.items():
            cents[i] = [sum(c) // len(vs) for c in zip(*vs)]
    final = [(k, *near(v)) for k, v in kept] if cents else []
    total, by = sum(d for _, d, _ in final), {}
    for _, d, i in final:
        by[i] = by.get(i, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(k, i, min(d, LONG), min(by[i], LONG), min(total, LONG), sha[i]) for k, d, i in final], key=repr)


def rows_of(df):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()], key=repr)


def made(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.selectExpr("*", "vec_id cluster", "vec_id id", "embedding v", "vec_id distance")  # names that are used inside


def vectors(n, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [c + rnd.gauss(0, 0.4) for c in centres[i % 5]]) for i in range(n)]


def test_same_as_definition(spark):
    rows = vectors(300)
    assert rows_of(cluster_vectors(made(spark, rows))) == plain(rows)


def test_odd_vectors(spark):
    rows = vectors(40)
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [nan] + [1.0] * 63, [0.0] * 63 + [-inf]]
    rows += [(100 + i, v) for i, v in enumerate(bad)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (200, [0.0] * 64), (201, [0.0] * 64)]
    assert rows_of(cluster_vectors(made(spark, rows))) == plain(rows)


@pytest.mark.parametrize("large", [5e4, 1e9, 1e306])
def test_large_components(spark, large):
    rows = [*vectors(12), (50, [large] * 64), (51, [-large] + [1.0] * 63)]
    rows = [(k, v) for k, v in rows]
    got, want = rows_of(cluster_vectors(made(spark, rows), rounds=2)), plain([(k, [x if abs(x) < 1e300 else math.copysign(1e300, x) for x in v]) for k, v in rows], rounds=2)
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 3)], [(None, [1.0] * 64)], [(1, [0.5] * 64)], [(9, [-0.3] * 64)] * 20])
def test_few_rows(spark, rows):
    got = rows_of(cluster_vectors(made(spark, rows)))
    assert got == plain(rows)


def test_float_vectors_and_names(spark):
    df = spark.createDataFrame([(i, [i / 7] * 64) for i in range(10)], "name string, values array<float>")
    got = cluster_vectors(df, key="name", vector="values")
    assert got.columns[0] == "name" and got.count() == 10


def test_search_rejects_and_is_exact():
    rnd = np.random.default_rng(4)
    cents = rnd.integers(-3000, 3000, (200, 64)) + rnd.integers(-3000, 3000, (200, 1))
    x = np.concatenate([cents[rnd.integers(0, 200, 900)] + rnd.integers(-40, 40, (900, 64)), rnd.integers(-2, 2, (100, 64)), cents[:9]])
    cents = np.concatenate([cents, cents[:20], np.zeros((3, 64), dtype=np.int64)])  # equal ones, too
    d = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    tally = {}
    labels, best = nearest(x, cents.tolist(), tally)
    assert (labels == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert tally["measured"] < 0.2 * d.size
