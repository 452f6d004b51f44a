"""Centroid clustering of integer vectors, in JVM-side expressions only.

Every component becomes ``floor(scale * x)``, so all sums are exact.  A vector's distances to
all centroids are ``zip_with`` and ``aggregate`` over a literal array of arrays, and the
smallest ``(distance, number)`` struct names its cluster.  New centroids are sums of single
columns by cluster: Spark adds them up inside each task, and ``k`` rows of ``dims`` sums come
to the driver, whatever the table holds.  Nothing else is collected but the ``k`` starting
vectors.  Each round reads the rows once; a vector never leaves the task that reads it.

Defined cases: a vector that is null, has not exactly ``dims`` components, or has a null or
non-finite one is left out; a null id is written as null and starts no cluster while others
can; repeated ids and equal vectors are rows of their own, equal hashes are ordered by the
vector; with fewer vectors than ``k`` each starts a cluster; an empty table gives no rows;
other columns are not looked at, so their names cannot clash.  A component beyond 2**27 after
scaling, of which the squared distance is no long, ends the query with an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .base import staged

LARGEST = 1 << 27


def _kept(rows: DataFrame, id: str, vector: str, dims: int) -> DataFrame:
    finite = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return rows.select(
        F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vec")
    ).where((F.size("vec") == dims) & finite)


def _scaled(x: Column, scale: int) -> Column:
    return F.when(
        F.abs(x) * scale > LARGEST, F.raise_error(F.lit("component too large for exact distances"))
    ).otherwise(F.floor(x * scale))


def _literal(vectors: list[list[int]]) -> Column:
    """All centroids as one literal, given as text: one call, not one for each number."""
    rows = (f"array({', '.join(f'{x}L' for x in v)})" for v in vectors)
    return F.expr(f"array({', '.join(rows)})")


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """``struct(distance, cluster)`` of the nearest centroid, the smaller number on ties."""

    def distance(v: Column, c: Column) -> Column:
        parts = F.zip_with(v, c, lambda a, b: a - b)
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, d: acc + d * d)

    return let(
        vector,
        lambda v: F.array_min(
            F.transform(
                _literal(centroids),
                lambda c, i: F.struct(distance(v, c).alias("distance"), i.alias("cluster")),
            )
        ),
    )


def _starts(kept: DataFrame, ints: Column, k: int, seed: str) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(order.alias("h"), ints.alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return [list(row["v"]) for row in first.collect()]


def centroids_of(kept: DataFrame, ints: Column, starts: list[list[int]], rounds: int, scale: int) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; an empty cluster keeps its own."""
    centroids = [list(c) for c in starts]
    sums = [F.sum(_scaled(F.get("vec", F.lit(i)), scale)).alias(f"s{i}") for i in range(len(starts[0]))]
    for _ in range(rounds):
        grouped = kept.groupBy(nearest(ints, centroids)["cluster"].alias("cluster"))
        for row in grouped.agg(F.count("*").alias("n"), *sums).collect():
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(sums))]
    return centroids


def cluster_vectors(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: str = "2",
) -> DataFrame:
    """One row per vector kept: its id, ``cluster``, ``distance``, ``cluster_inertia``,
    ``inertia``, ``centroid`` (the components, joined by commas) and ``centroid_sha256``."""
    kept = _kept(rows, id, vector, dims)
    ints = F.transform("vec", lambda x: _scaled(x, scale))
    centroids = _starts(kept, ints, k, seed)
    if not centroids:  # no vector, so no row either, but all columns
        centroids = [[0] * dims]
    else:
        centroids = centroids_of(kept, ints, centroids, rounds, scale)
    near = kept.select(F.col("id").alias(id), nearest(ints, centroids).alias("near"))
    near = staged(near.select(id, "near.cluster", "near.distance"), "clusters")
    inertia = [0] * len(centroids)
    for row in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect():
        inertia[row["cluster"]] = row["s"]
    texts = [",".join(map(str, c)) for c in centroids]
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    def of(values: list, kind) -> Column:
        return F.get(F.expr(f"array({', '.join(kind(v) for v in values)})"), F.col("cluster"))

    return near.select(
        id,
        "cluster",
        "distance",
        of(inertia, lambda v: f"{v}L").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        of(texts, repr).alias("centroid"),
        of(hashes, repr).alias("centroid_sha256"),
    )
