"""Centroid clustering with n-simplex projections (Connor, Vadicamo et al.,
"High-dimensional simplexes for supermetric search", 2017).

The pivots span a simplex. A vector's distances to them, taken once, fix the
apex that it forms over that simplex: its place in the pivots' plane and its
height above it. Of two vectors, the distance of the apexes is a lower bound of
their own distance, and with one apex mirrored below the plane an upper bound.
In each round a centroid whose lower bound is over the least upper bound is out;
the rest are compared by exact integer distances.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import materialize
from shoplens.llm.vectors import whole_vectors

#: Vectors, by their hash, of which the pivots are chosen, and pivots at most.
SAMPLE, PIVOTS = 256, 24
#: Largest entry, so that a squared distance and its sums fit into 64 bits.
LARGEST = 1 << 26
#: Share of the distances by which a bound may be off through rounding (the
#: pivots' heights are at least ``FLAT`` of their largest distance).
SLACK, FLAT = 1e-5, 1e-2


class Simplex(NamedTuple):
    """Pivots, and the lower triangle of their coordinates in their plane (the
    first is the origin)."""
    pivots: np.ndarray
    lower: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` from the vector ``b``."""
    d = a.astype(np.int64) - b
    return (d * d).sum(axis=1)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> Simplex:
    """Pivots out of ``sample``: each is the vector farthest from the plane of
    those before it, as long as that is far enough for stable coordinates."""
    x = sample.astype(np.float64) - sample[0]
    chosen, axes = [0], np.empty((0, x.shape[1]))
    rest = x.copy()
    widest = np.sqrt((x * x).sum(axis=1).max())
    while len(chosen) < min(most, len(x)):
        height = np.sqrt((rest * rest).sum(axis=1))
        i = int(height.argmax())
        if height[i] <= FLAT * widest:
            break
        axis = rest[i] / height[i]
        axis -= axes.T @ (axes @ axis)  # once more, against rounding
        axes = np.vstack([axes, axis / np.sqrt(axis @ axis)])
        rest = x - (x @ axes.T) @ axes
        chosen.append(i)
    return Simplex(sample[chosen], np.tril(x[chosen[1:]] @ axes.T))


def apexes(q: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Apex of each row over the pivots: coordinates in their plane, height."""
    d = np.stack([squared(q, p) for p in simplex.pivots], axis=1).astype(np.float64)
    base = simplex.lower
    own = (base * base).sum(axis=1)
    y = np.linalg.solve(base, ((d[:, :1] - d[:, 1:] + own) / 2).T).T if len(base) else np.empty((len(q), 0))
    height = np.sqrt(np.maximum(d[:, 0] - (y * y).sum(axis=1), 0.0))
    return np.column_stack([y, height])


def candidates(apex: np.ndarray, centre_apex: np.ndarray) -> np.ndarray:
    """(row, centroid) -> whether the centroid can be a nearest one."""
    norm, centre_norm = (apex * apex).sum(axis=1), (centre_apex * centre_apex).sum(axis=1)
    low = np.maximum(norm[:, None] + centre_norm - 2 * apex @ centre_apex.T, 0.0)
    high = low + 4 * apex[:, -1:] * centre_apex[:, -1]
    low, high = np.sqrt(low), np.sqrt(high)
    off = SLACK * (np.sqrt(norm)[:, None] + np.sqrt(centre_norm))
    return low - off <= (high + off).min(axis=1, keepdims=True)


def nearest(q: np.ndarray, apex: np.ndarray, centres: np.ndarray, centre_apex: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, number of exact distances taken); ties go to the
    smaller number."""
    left = candidates(apex, centre_apex)
    cluster = left.argmax(axis=1)
    open_ = left.sum(axis=1) > 1
    best = np.full(len(q), np.iinfo(np.int64).max)
    taken = 0
    for c in range(len(centres)):
        rows = np.flatnonzero(open_ & left[:, c])
        taken += len(rows)
        d = squared(q[rows], centres[c])
        closer = d < best[rows]
        best[rows[closer]], cluster[rows[closer]] = d[closer], c
    return cluster, taken


def kept_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, q) of rows (vec_id, embedding) with ``dim`` finite entries x;
    q holds floor(scale * x) as little-endian 32-bit integers."""
    def run(batches):
        for b in batches:
            at, size, values = whole_vectors(b.column(1))
            values = values[np.repeat(size == dim, size)].reshape(-1, dim)
            q = np.floor(scale * values)
            if q.size and np.abs(q).max() > LARGEST:
                raise ValueError(f"entries over {LARGEST / scale} have squared distances beyond 64 bits")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at[size == dim])),
                 pa.array([v.tobytes() for v in q.astype("<i4")], pa.binary())], names=["vec_id", "q"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, q binary")


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def simplex_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024,
                     seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
                     ) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids): vec_id, cluster and distance (squared) of each
    row whose vector has exactly ``dim`` entries, none of them null or
    non-finite; cluster, centroid (array of long), size, cluster_inertia and
    inertia of each cluster.

    Entries become floor(scale * x). The first centroids are the ``k`` kept
    rows with the smallest sha256 of "seed:id" (equal hashes: by the vector's
    bytes), all of them if there are fewer. A round assigns each row to the
    nearest centroid, ties to the smaller number, then moves each centroid that
    has rows to the floor of their mean; after the last round rows are assigned
    once more. Repeated rows count as often as they occur; a null id hashes as
    the empty string. Without kept rows both tables are empty. Entries over
    2^26 after scaling raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    kept = kept_vectors(rows, dim, scale)
    order: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(order, "q").limit(max(k, SAMPLE)).select("q").toArrow()
    sample = _matrix(first.column(0), "<i4", dim).astype(np.int64)
    centres = sample[:k]
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if not len(sample):
        return (spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"),
                spark.createDataFrame([], "cluster int, centroid array<long>, size long, cluster_inertia long, "
                                          "inertia long"))
    simplex = choose_pivots(sample)
    width = len(simplex.pivots)

    def project(batches):
        for b in batches:
            q = _matrix(b.column(1), "<i4", dim)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([v.tobytes() for v in apexes(q, simplex)], pa.binary())],
                names=["vec_id", "q", "apex"])

    cached = materialize(kept.mapInArrow(project, f"vec_id {id_type}, q binary, apex binary"), "apexes")

    def moved(centres: np.ndarray) -> np.ndarray:
        centre_apex = apexes(centres, simplex)

        def sums(batches):
            n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dim), np.int64)
            for b in batches:
                q = _matrix(b.column(0), "<i4", dim)
                cluster, _ = nearest(q, _matrix(b.column(1), "<f8", width), centres, centre_apex)
                n += np.bincount(cluster, minlength=len(centres))
                for c in np.unique(cluster).tolist():
                    total[c] += q[cluster == c].sum(axis=0, dtype=np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                names=["cluster", "n", "total"])

        parts = cached.select("q", "apex").mapInArrow(sums, "cluster int, n long, total array<long>")
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
            *[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")).collect()  # a row per centroid
        out = centres.copy()
        for r in found:
            out[r.cluster] = [t // r.n for t in r.total]
        return out

    for _ in range(rounds):
        now = moved(centres)
        if (now == centres).all():  # no later round moves anything
            break
        centres = now
    centre_apex = apexes(centres, simplex)

    def assign(batches):
        for b in batches:
            q = _matrix(b.column(1), "<i4", dim)
            cluster, _ = nearest(q, _matrix(b.column(2), "<f8", width), centres, centre_apex)
            d = q - centres[cluster]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()),
                                              pa.array((d * d).sum(axis=1), pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    done = materialize(cached.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long"), "clusters")
    own = {r.cluster: r for r in done.groupBy("cluster").agg(  # a row per centroid
        F.count(F.lit(1)).alias("size"), F.sum("distance").alias("inertia")).collect()}
    total = sum(r.inertia for r in own.values())
    summary = [(c, v.tolist(), own[c]["size"] if c in own else 0, own[c].inertia if c in own else 0, total)
               for c, v in enumerate(centres)]
    return done, spark.createDataFrame(
        summary, "cluster int, centroid array<long>, size long, cluster_inertia long, inertia long")
