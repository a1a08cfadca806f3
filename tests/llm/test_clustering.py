import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinmap.llm import clustering


def expected(rows, k=16, rounds=3, size=64):
    """The definition on Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=rank)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
        if turn < rounds:
            for j in range(len(now)):
                if mine := [v for (_, v), (_, a) in zip(kept, own) if a == j]:
                    now[j] = [sum(x) // len(mine) for x in zip(*mine)]
    total = sum(d for d, _ in own)
    sums = {j: sum(d for d, a in own if a == j) for _, j in own}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, j, d, sums[j], total, sha[j]) for (i, _), (d, j) in zip(kept, own)), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in clustering.cluster(df, **options).collect()), key=repr)


def test_equals_the_definition_on_groups(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (12, 64))
    rows = [(i, (centers[i % 12] + rng.normal(0, 0.2, 64)).tolist()) for i in range(600)]
    report = {}
    assert made(spark, rows, report=report) == expected(rows)
    assert report["scanned"][0] == 600 * 16 and all(n < 600 * 16 for n in report["scanned"][1:])


def test_ties_repeated_vectors_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(60)] + [(7, [1.0] * 64), (None, [1.0] * 64), (None, [2.0] * 64)]
    assert made(spark, rows) == expected(rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_points_on_a_line(spark, size):
    rows = [(i, [float(i * 7 % 23) / 8] * size) for i in range(90)]
    assert made(spark, rows, components=size, k=7, rounds=6) == expected(rows, 7, 6, size)


def test_odd_vectors_are_left_out(spark):
    good = [(i, [i / 10.0 + j for j in range(64)]) for i in range(5)]
    odd = [(10, None), (11, []), (12, [1.0] * 63), (13, [1.0] * 65), (14, [1.0] * 63 + [None]), (15, [float("nan")] + [1.0] * 63), (16, [float("-inf")] + [1.0] * 63)]
    assert made(spark, good + odd) == expected(good + odd)
    assert made(spark, odd) == [] and made(spark, []) == []


def test_large_components_are_exact_and_bounded(spark):
    rows = [(i, [float((i * 7919 % 100) * 20_000 + j) for j in range(64)]) for i in range(100)]
    assert made(spark, rows) == expected(rows)
    assert len(made(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)])) == 2


def test_extra_columns(spark):
    rows = [(i, [float(i * j % 5) for j in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("id", "v", "cluster", "distance", "count", "inertia")))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in clustering.cluster(df).collect()), key=repr) == expected(rows)


def test_bounds_never_change_an_assignment():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8):
        x = rng.integers(-9, 9, (400, size)).astype(np.int64)
        now = x[:10].copy()
        a, u, low, _ = clustering.Centroids(now).first(x)
        for _ in range(8):
            old, now = now, now + rng.integers(-1, 2, now.shape)
            c = clustering.Centroids(now, old)
            a, u, low, _ = c.follow(x, a, u, low)
            d = ((x[:, None] - now) ** 2).sum(-1)
            assert (a == d.argmin(1)).all()
