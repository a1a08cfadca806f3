"""Clustering around centroids: Lloyd's rounds with exponion search.

Vectors carry their centroid, an upper bound of the distance to it and a lower bound of the distance
to any other.  When centroids move, the bounds move with them; a vector whose upper bound stays below
the lower one, or below half the way from its centroid to the next, is settled without a distance.
Any other scans only the centroids within ``2 * upper + gap`` of its own (gap: from its centroid to
the nearest other one): the nearest and the second nearest lie in this ball.  Candidates are read off
the front of a list sorted by distance between centroids; the radius is inclusive and a little wide,
so that ties, which the smaller number wins, are never decided by rounding.

Components are integers and distances, sums and new centroids exact.  A round maps the vectors once
and writes them with their bounds; each task adds rows of its sums, at most one a centroid, so only
those are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from veinmap.llm.common import cut_to, parsed, remove

#: Components beyond this (after scaling) count as this: squared distances then fit 64 bits.
LARGEST = 1 << 27
#: Up to this, squared distances are exact as sums of doubles.
_SMALL = 1 << 22
#: By how much bounds are widened, relatively: rounding errors are far smaller.
SLACK = 1e-9
#: Rows at a time where distances are formed as integers.
_ROWS = 1024
_STATE = "v array<int>, cluster int, upper double, lower double, distance long, count long, sums array<long>, inertia decimal(38,0), scanned long"
_MOST = (1 << 63) - 1


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows ``x`` to rows ``c``."""
    if not len(x) or max(np.abs(x).max(), np.abs(c).max()) <= _SMALL and x.shape[1] <= 64:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)).astype(np.int64)
    parts = [((x[k : k + _ROWS, None, :] - c) ** 2).sum(-1) for k in range(0, len(x), _ROWS)]
    return np.concatenate(parts)


class Centroids:
    """Centroids, and for each the sorted list of the others by distance."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, k = now, len(now)
        self.apart = np.sqrt(squared(now, now))
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.apart, self.order, axis=1)
        self.gap = np.where(np.eye(k, dtype=bool), np.inf, self.apart).min(axis=1) if k else np.zeros(0)
        self.moved = np.sqrt(((now - before).astype(np.float64) ** 2).sum(1)) if before is not None else None

    def scan(self, x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its nearest of the centroids ``among`` (ascending), the squared distance, and the second's distance."""
        d = squared(x, self.now[among])
        best = d.argmin(axis=1)
        second = np.sqrt(np.partition(d, 1, axis=1)[:, 1]) if d.shape[1] > 1 else np.full(len(x), np.inf)
        return among[best], d[np.arange(len(x)), best], second

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper, lower of rows without bounds, and how many distances that took."""
        cluster, d, lower = self.scan(x, np.arange(len(self.now)))
        return cluster, np.sqrt(d), lower, len(x) * len(self.now)

    def follow(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same of rows with bounds, after the centroids moved."""
        two = np.argsort(self.moved)[-2:]
        most = np.where(cluster == two[-1], self.moved[two[0]] if len(two) > 1 else 0.0, self.moved[two[-1]])
        upper, lower, cluster = upper + self.moved[cluster], lower - most, cluster.copy()
        open_ = lambda rows: rows[upper[rows] * (1 + SLACK) >= np.maximum(lower[rows] * (1 - SLACK), self.gap[cluster[rows]] * (0.5 - SLACK))]
        rows = open_(np.arange(len(x)))
        upper[rows] = np.sqrt(self.own(x[rows], cluster[rows]))
        scanned, rows = len(rows), open_(rows)
        start = cluster[rows]
        for a in np.unique(start):
            mine = rows[start == a]
            ball = np.searchsorted(self.sorted[a], (2 * upper[mine] + self.gap[a]) * (1 + SLACK), "right")
            for m in np.unique(ball):
                some = mine[ball == m]
                found, d, lower[some] = self.scan(x[some], np.sort(self.order[a, :m]))
                cluster[some], upper[some] = found, np.sqrt(d)
                scanned += len(some) * int(m)
        return cluster, upper, lower, scanned

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to their centroids."""
        return ((x - self.now[cluster]) ** 2).sum(1)


def integers(vector: Column, components: int, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))).cast("int"))


def usable(vector: Column, components: int) -> Column:
    """Exactly ``components`` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == components) & F.forall(vector, finite), F.lit(False))


def _round(rows: DataFrame, id_type: str, old: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """One assignment of rows (id, v[, cluster, upper, lower]): the rows with new bounds and distances, and a task's sums by centroid."""
    ddl = f"id {id_type}, {_STATE}"
    schema = to_arrow_schema(parsed(ddl), prefers_large_types=False)
    columns = ["id", "v"] + (["cluster", "upper", "lower"] if old is not None else [])
    k, size = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(now, old)
        count, sums, inertia, scanned = np.zeros(k, np.int64), np.zeros((k, size), np.int64), [0] * k, 0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            if old is None:
                cluster, upper, lower, n = centroids.first(x)
            else:
                cluster, upper, lower, n = centroids.follow(x, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]))
            d = centroids.own(x, cluster)
            scanned += n
            for c in np.unique(cluster):
                own = cluster == c
                count[c] += own.sum()
                sums[c] += x[own].sum(axis=0)
                inertia[c] += sum(d[own].tolist())
            none = [pa.nulls(len(x), t) for t in schema.types[6:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.types[0]), batch.column(1).cast(schema.types[1]), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(d), *none], schema=schema)
        used = np.flatnonzero(count)
        if len(used):
            values = [pa.nulls(len(used), t) for t in schema.types[:6]]
            values[2] = pa.array(used, pa.int32())
            values += [pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64())), pa.array([Decimal(inertia[c]) for c in used], pa.decimal128(38, 0)), pa.array([scanned] + [0] * (len(used) - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays([v.cast(t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

    return rows.select(*columns).mapInArrow(run, ddl)


def totals(state: DataFrame, size: int) -> list:
    """A row for each centroid with vectors: cluster, n, inertia, scanned, sums."""
    parts = state.where("count IS NOT NULL").groupBy("cluster")
    return parts.agg(F.sum("count").alias("n"), F.sum("inertia").alias("inertia"), F.sum("scanned").alias("scanned"), F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("sums")).collect()


def starts(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed`` and their id (ties: by components)."""
    rank = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()], np.int64)  # k rows


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """Clusters vectors: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with other than ``components`` components, or with one that is null or non-finite, are
    left out; a component x becomes floor(scale * x), within +-LARGEST.  Centroids start as ``starts``
    gives them; each round assigns every vector to the nearest (squared distance; ties: the smaller
    number) and replaces every centroid that has vectors by the floor of their mean; a last assignment
    follows.  ``distance`` is squared; sums of it beyond 64 bits count as the largest long.  Fewer
    than ``k`` vectors give fewer centroids, no vectors no rows.  A null id is an id; repeated rows
    stay; other columns are not looked at.  ``report``, a dict, gets ``scanned``: how many distances
    each round took.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col)
    rows = vectors.where(usable(vector, components)).select(F.col(id_col).alias("id"), integers(vector, components, scale).alias("v"))
    now, old, path = starts(rows, k, seed), None, None
    out_ddl = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(now):
        return spark.createDataFrame([], out_ddl)
    scanned = []
    for turn in range(rounds + 1):
        state, new_path = cut_to(_round(rows, id_type, old, now), "exponion")
        if path:
            remove(spark, path)  # the state before: nothing reads it any more
        found = {r.cluster: r for r in totals(state, components)}
        scanned.append(int(sum(r.scanned for r in found.values())))
        rows, path = state.where("count IS NULL"), new_path
        if turn < rounds:
            old, now = now, np.array([[s // found[c].n for s in found[c].sums] if c in found else own.tolist() for c, own in enumerate(now)], np.int64)
    if report is not None:
        report["scanned"] = scanned
    every = min(_MOST, int(sum(r.inertia for r in found.values())))
    about = [(c, min(_MOST, int(r.inertia)), every, hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, r in sorted(found.items())]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return rows.select("id", "cluster", "distance").join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3) -> str:
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""]
    for t in range(rounds + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d
  FROM (SELECT r, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda j: CAST((v[j] - m[j]) * (v[j] - m[j]) AS HUGEINT))) AS d FROM v, c{t}) GROUP BY r, vec_id, v)""")
        if t < rounds:
            parts.append(f"""
c{t + 1} AS MATERIALIZED (
  SELECT c{t}.c, coalesce(x.m, c{t}.m) AS m FROM c{t} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m
    FROM (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{t}, range(1, 65) AS t(j) GROUP BY c, j) GROUP BY c) x ON x.c = c{t}.c)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} b ON a.c = b.c
"""
