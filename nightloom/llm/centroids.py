"""Clustering of integer vectors around centroids by equal-average equal-variance search.

Centroids are sorted by the sum of their components. From the place of a vector's own sum the search goes outward on both sides. With D components,
D * distance is at least (difference of sums)^2, so a side is over once that exceeds D * the best distance; and it is at least
(difference of sums)^2 + (difference of deviations)^2, which rejects single centroids. What is left is measured in integers.
Tasks assign blocks of vectors and hand on sums by cluster; the centroids, of a fixed number, are what the driver holds between rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightloom.llm.common import saved

LARGEST = 1 << 40  # of a component's absolute value
LONG = (1 << 63) - 1
BLOCK = 4096  # vectors measured at once


def _measured(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest by Python's own integers, for vectors too large for 64 bits; distances stop at the largest long."""
    labels, distances = [], []
    for v in x.tolist():
        d, label = min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
        labels.append(label)
        distances.append(min(d, LONG))
    return np.array(labels, dtype=np.int64), np.array(distances, dtype=np.int64)


def nearest(x: np.ndarray, centroids: list[list[int]], tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each vector's nearest centroid, the smaller number among equals. tally counts the distances that were measured."""
    n, dims = x.shape
    limit = (1 << 30) // dims  # up to here sums, squares and D * distance stay within 64 bits
    if any(abs(v) > limit for c in centroids for v in c):
        return _measured(x, centroids)
    large = (np.abs(x) > limit).any(axis=1)
    labels, best = np.full(n, len(centroids), dtype=np.int64), np.full(n, dims * (2 * limit) ** 2, dtype=np.int64)
    if large.any():
        labels[large], best[large] = _measured(x[large], centroids)
    rows = np.flatnonzero(~large)
    c = np.array(centroids, dtype=np.int64)
    sums, own = x[rows].sum(axis=1), c.sum(axis=1)
    spread = np.sqrt(dims * (x[rows] ** 2).sum(axis=1) - sums**2)
    own_spread = np.sqrt(dims * (c**2).sum(axis=1) - own**2)
    order = np.lexsort((np.arange(len(c)), own))
    start = np.searchsorted(own[order], sums)
    sides = {1: np.arange(len(rows)), -1: np.arange(len(rows))}
    for step in range(len(c)):
        for way, at in sides.items():
            place = start[at] + step if way == 1 else start[at] - 1 - step
            at, place = at[(place >= 0) & (place < len(c))], place[(place >= 0) & (place < len(c))]
            one = order[place]
            apart = (sums[at] - own[one]) ** 2
            near = apart <= dims * best[rows[at]]  # all further ones of this side are at least as far apart
            sides[way] = at = at[near]
            one, apart = one[near], apart[near]
            # Deviations are rounded: what could be rounding is taken off.
            off = np.maximum(np.abs(spread[at] - own_spread[one]) - 1e-13 * (spread[at] + own_spread[one]), 0)
            near = (apart + off**2) * (1 - 1e-12) <= dims * best[rows[at]]
            one, r = one[near], rows[at[near]]
            distance = ((x[r] - c[one]) ** 2).sum(axis=1)
            if tally is not None:
                tally["measured"] = tally.get("measured", 0) + len(r)
            better = (distance < best[r]) | (distance == best[r]) & (one < labels[r])
            labels[r[better]], best[r[better]] = one[better], distance[better]
    return labels, best


def _blocks(batch):
    """The vectors of an Arrow batch as arrays of at most BLOCK rows."""
    for at in range(0, batch.num_rows, BLOCK):
        some = batch.slice(at, BLOCK)
        v = some.column("v")
        yield some, v.flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)


def _totals(vectors: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, list[int]]:
    """Of every cluster with vectors: the exact sum of each component, and how many vectors; at most clusters * (dims + 1) numbers."""

    def summed(batches):
        import pyarrow as pa

        for batch in batches:
            for _, x in _blocks(batch):
                labels, _ = nearest(x, centroids)
                kinds = np.unique(labels)
                sums = [[*x[labels == k].sum(axis=0).tolist(), int((labels == k).sum())] for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "sums"])

    made = vectors.select("v").mapInArrow(summed, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "x"))
    out: dict[int, list[int]] = {}
    for row in made.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out.setdefault(row.cluster, [0] * (dims + 1))[row.i] = int(row.x)
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with dims components, none of them null or not finite; other rows are left out.

    Components become floor(scale * x), at most 2^40 either way. Distances and sums beyond a long are the largest long. The first centroids are the vectors whose ids have the smallest hashes, smaller
    components first where ids repeat; rows with a null id begin no cluster but belong to one. With fewer vectors there are fewer clusters; with none, or none with an id, no rows.
    """
    fit = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * scale)))
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(fit)
    kept = saved(kept.select("id", F.transform("v", whole).alias("v")), "vectors")
    hashed = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "v")
    centroids = [list(r.v) for r in hashed.orderBy("hash", "v").limit(clusters).collect()]
    name = lambda df: df.withColumnRenamed("id", key)
    if not centroids:
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        return name(kept.where("false").select("id", none("cluster", "int"), none("distance", "long"), none("cluster_inertia", "long"), none("inertia", "long"), none("centroid_sha256", "string")))
    for _ in range(rounds):
        for k, (*sums, n) in _totals(kept, centroids, dims).items():
            centroids[k] = [s // n for s in sums]

    def assigned(batches):
        import pyarrow as pa

        for batch in batches:
            for some, x in _blocks(batch):
                labels, distances = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(labels, pa.int32()), pa.array(distances, pa.int64())], names=["id", "cluster", "distance"])

    final = saved(kept.mapInArrow(assigned, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long"), "assigned")
    long = lambda c: F.least(F.col(c), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias(c)
    by = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia")).withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # a row a cluster
    digest = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    digest = kept.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string")
    facts = by.join(F.broadcast(digest), "cluster").select("cluster", long("cluster_inertia"), long("inertia"), "centroid_sha256")
    return name(final.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def sql(clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same, from the definition: all distances in every round."""
    out = [
        f"""WITH e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
kept AS (SELECT vec_id FROM e GROUP BY vec_id HAVING count(*) = {dims} AND count(e) = {dims} AND bool_and(isfinite(e))),
x AS MATERIALIZED (SELECT vec_id, i, CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) AS q FROM kept JOIN e USING (vec_id)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {clusters}),
c0 AS MATERIALIZED (SELECT k, i, q FROM seeds JOIN x USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        out.append(
            f"""d{r} AS (SELECT vec_id, k, sum((x.q - c.q) * (x.q - c.q)) AS d FROM x JOIN c{r} c USING (i) GROUP BY vec_id, k),
a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        )
        if r < rounds:
            out.append(
                f"""s{r} AS (SELECT k, i, CAST(sum(q) AS HUGEINT) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN s IS NULL THEN q ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS q FROM c{r} LEFT JOIN s{r} USING (k, i))"""
            )
    out.append(f"digest AS (SELECT k, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return (
        ",\n".join(out)
        + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN digest USING (k)"""
    )
