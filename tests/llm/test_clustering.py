"""Centroid clustering against plain Python, and the defined cases."""

import hashlib
import math
import random

import pytest

from veilspark.llm.clustering import cluster_vectors

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, vec double"


def brute(rows, k, rounds, dims):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() for i, _ in kept if i is not None}
    order = sorted(kept, key=lambda r: (r[0] is None, digest.get(r[0]), r[1]))
    centroids = [v for _, v in order[:k]]

    def assigned():
        return [
            min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
            for _, v in kept
        ]

    for _ in range(rounds):
        found = assigned()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    inertia = [sum(d for d, m in found if m == n) for n in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, m, d, inertia[m], sum(inertia), names[m]) for (i, _), (d, m) in zip(kept, found)),
        key=repr,
    )


def run(spark, rows, k, rounds, dims):
    table = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], SCHEMA)
    out = cluster_vectors(table, k=k, rounds=rounds, dims=dims)
    assert out.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    ]
    got = out.drop("centroid").collect()
    return sorted((tuple(r) for r in got), key=repr)


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_random_vectors_with_ties_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, [single(rng.gauss(0, 0.3)) for _ in range(4)]) for i in range(150)]
    rows += [(i, [0.25, -0.25, 0.0, 0.5]) for i in range(200, 260)]  # equal vectors
    rows += rows[:10]  # repeated rows
    rows += [(7, [3.0, 3.0, 3.0, 3.0])]  # an id with two vectors
    assert run(spark, rows, 9, 5, 4) == brute(rows, 9, 5, 4)


def test_left_out_and_null_ids(spark):
    bad = [None, [], [1.0], [1.0, None], [1.0, float("nan")], [float("-inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(bad)]
    rows += [(None, [5.0, 5.0]), (100, [0.0, 0.0]), (101, [5.0, 4.5]), (102, [-0.001, -0.002])]
    assert run(spark, rows, 2, 5, 2) == brute(rows, 2, 5, 2)
    assert len(run(spark, rows, 2, 5, 2)) == 4


def test_fewer_vectors_than_clusters_and_empty_clusters(spark):
    rows = [(i, [float(i // 2)] * 3) for i in range(6)]  # three pairs, so three clusters stay empty
    assert run(spark, rows, 40, 5, 3) == brute(rows, 40, 5, 3)
    assert run(spark, rows[:1], 40, 5, 3) == brute(rows[:1], 40, 5, 3)


def test_empty_table(spark):
    assert run(spark, [], 40, 5, 64) == []
    assert run(spark, [(1, None)], 40, 5, 64) == []


def test_too_large_components_end_with_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], 2, 1, 2)
