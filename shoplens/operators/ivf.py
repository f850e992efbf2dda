"""Top-n products per user over a clustered inverted file, exact by a bound.

Products are grouped into lists around centroids. A user is scored against a
few lists first; the n-th best score so far, and the least and largest angle
of each list to its centroid, then say which other lists can hold a better
product. A user without such a list is certified; the others are scored against
exactly those lists. The result is that of scoring all products; how much is
scored depends on how well the vectors cluster.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.operators.recommend import SCORE_BLOCK, best_of, score_cells, topn_per_user
from shoplens.session import materialize

#: Products (by a hash of the id) on which the centroids are fitted, and lists at most.
SAMPLE, LISTS = 1 << 15, 1 << 12
#: Lists that every user is scored against.
PROBES = 4
#: Slack of a bound: ties of rounded scores, rounding of angles.
SLACK = 1e-7


class Index(NamedTuple):
    """``rows`` (product_id, vector, list) of every product with a direction;
    on the driver, a row per list: centroids of length one, number of
    products, least and largest angle to the centroid."""
    rows: DataFrame
    centroids: np.ndarray
    size: np.ndarray
    near: np.ndarray
    far: np.ndarray


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors of length one) of the vectors that have a direction."""
    some = [(i, v) for i, v in enumerate(column.to_pylist()) if v]
    m = np.array([v for _, v in some], np.float64)
    at = np.array([i for i, _ in some], np.int64)
    if not len(some):
        return at, np.empty((0, 0))
    norm = np.sqrt((m * m).sum(axis=1))
    return at[norm > 0], m[norm > 0] / norm[norm > 0, None]


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced rows."""
    c = np.unique(sample, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(lists, len(c))).astype(int)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def build_index(products: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The inverted file of ``products`` (product_id, vector), written once:
    every product with a direction is in the list of its nearest centroid. The
    centroids are fitted on at most ``sample`` products, chosen by a hash;
    their number is the root of the number of products, at most ``LISTS``."""
    p = products.select(F.col("product_id").cast("bigint").alias("product_id"),
                        F.col("vector").cast("array<double>").alias("vector")).dropna()
    head = p.orderBy(F.xxhash64("product_id"), "product_id").limit(sample).select("vector").toArrow()
    _, x = _unit(head.column(0).combine_chunks())
    if lists is None:
        lists = max(1, min(LISTS, int(np.sqrt(p.count()))))
    centroids = fit_centroids(x, lists) if len(x) else np.empty((0, 0))

    def assign(batches):
        for b in batches:
            at, x = _unit(b.column(1))
            if len(at):
                cos = x @ centroids.T
                own = cos.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(own, pa.int32()),
                     pa.array(_angles(cos[np.arange(len(own)), own]))],
                    names=["product_id", "vector", "list", "angle"])

    rows = materialize(p.mapInArrow(assign, "product_id long, vector array<double>, list int, angle double"), "ivf")
    size, near, far = np.zeros(len(centroids), np.int64), np.zeros(len(centroids)), np.zeros(len(centroids))
    for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"),
                                      F.max("angle").alias("far")).collect():  # a row per list
        size[r["list"]], near[r["list"]], far[r["list"]] = r.n, r.near, r.far
    return Index(rows.select("product_id", "vector", "list"), centroids, size, near, far)


def _probed(cos: np.ndarray, index: Index, probes: int) -> np.ndarray:
    """(user, list) -> whether the list is among the nearest ``probes`` that hold products."""
    rank = np.where(index.size > 0, cos, -np.inf)
    keep = np.zeros(cos.shape, bool)
    np.put_along_axis(keep, np.argsort(-rank, axis=1, kind="stable")[:, :probes], True, axis=1)
    return keep & (index.size > 0)


def _score(visits: DataFrame, index: Index, seen: DataFrame | None, n: int, block: int) -> DataFrame:
    """Best ``n`` unseen products of each visit ``(user_id, vector, lists)``.
    Lists and the users that visit them are cut into blocks by a hash; a
    cell holds a block of each."""
    v = visits.select("user_id", "vector", F.explode("lists").alias("list"))
    users = np.ones(len(index.size), np.int64)
    for r in v.groupBy("list").count().collect():  # a row per list
        users[r["list"]] = max(1, -(-r["count"] // block))
    items = np.maximum(1, -(-index.size // block))
    # at most LISTS rows
    blocks = F.broadcast(visits.sparkSession.createDataFrame(
        [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(users, items))], "list int, _ub int, _pb int"))

    def numbered(df):
        return df.join(blocks, "list")

    def cell(u, p):
        return ((F.col("list").cast("bigint") * (1 << 20) + u) * (1 << 20) + p).alias("cell")

    own_u, own_p = F.pmod(F.xxhash64("user_id"), F.col("_ub")), F.pmod(F.xxhash64("product_id"), F.col("_pb"))
    other_u, other_p = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("_o") for c in ("_ub", "_pb"))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<double>")
    rows = numbered(v).select("*", other_p).select(cell(own_u, F.col("_o")), F.lit(0).alias("side"), "user_id",
                                                   zero.alias("product_id"), "vector")
    rows = rows.unionByName(numbered(index.rows).select("*", other_u).select(
        cell(F.col("_o"), own_p), F.lit(1).alias("side"), zero.alias("user_id"), "product_id", "vector"))
    if seen is not None:
        s = seen.select(F.col("user_id").cast("bigint").alias("user_id"),
                        F.col("product_id").cast("bigint").alias("product_id")).dropna().distinct()
        s = s.join(visits.select("user_id"), "user_id", "left_semi").join(index.rows.select("product_id", "list"), "product_id")
        rows = rows.unionByName(numbered(s).select(cell(own_u, own_p), F.lit(2).alias("side"), "user_id", "product_id",
                                                   none.alias("vector")))
    found = score_cells(rows, best_of(n), "user_id long, product_id long, score double")
    return topn_per_user(found, "score", n)


def ivf_topn(users: DataFrame, products: DataFrame, seen: DataFrame | None = None, n: int = 10,
             probes: int = PROBES, lists: int | None = None, block: int = SCORE_BLOCK,
             index: Index | None = None, report: dict | None = None) -> DataFrame:
    """Best ``n`` unseen products per user by cosine score, of all products:
    (user_id, product_id, score, rank), as ``exact_topn`` gives them. Ids are
    unique; users and products (id, vector) of length zero take no part; a list
    is short only when no more unseen products exist.

    ``report``, if given, takes ``users``, ``certified`` (users whose first
    lists were proven enough) and ``scored`` (share of all pairs scored).
    """
    index = index or build_index(products, lists)
    schema = "user_id long, product_id long, score double, rank int"
    if not len(index.centroids):
        return users.sparkSession.createDataFrame([], schema)
    u = users.select(F.col("user_id").cast("bigint").alias("user_id"),
                     F.col("vector").cast("array<double>").alias("vector")).dropna()

    shape = index._replace(rows=None)  # what tasks need of it

    def first(batches):
        for b in batches:
            at, x = _unit(b.column(1))
            if len(at):
                keep = _probed(x @ shape.centroids.T, shape, probes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)),
                     pa.array([np.flatnonzero(k).tolist() for k in keep], pa.list_(pa.int32()))],
                    names=["user_id", "vector", "lists"])

    def rest(batches):
        """Lists that were not visited and whose best possible cosine reaches the user's n-th best."""
        for b in batches:
            at, x = _unit(b.column(1))
            if not len(at):
                continue
            cos = x @ shape.centroids.T
            angle = _angles(cos)
            off = np.maximum(0.0, np.maximum(shape.near - angle, angle - shape.far))
            least = np.array(b.column(2).to_pylist(), np.float64)[at]
            keep = (np.cos(off) >= least[:, None] - SLACK) & (shape.size > 0) & ~_probed(cos, shape, probes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)),
                 pa.array([np.flatnonzero(k).tolist() for k in keep], pa.list_(pa.int32()))],
                names=["user_id", "vector", "lists"])

    visit = "user_id long, vector array<double>, lists array<int>"
    begun = materialize(u.mapInArrow(first, visit), "ivf-first")
    best = materialize(_score(begun, index, seen, n, block), "ivf-best")
    # the n-th best so far; a user with fewer products has none to beat
    least = best.where(F.col("rank") == n).select("user_id", F.col("score").alias("least"))
    open_ = u.join(least, "user_id", "left").select("user_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
    open_ = materialize(open_.mapInArrow(rest, visit).where(F.size("lists") > 0), "ivf-rest")
    if report is not None:
        visits = begun.select(F.explode("lists").alias("list")).unionAll(open_.select(F.explode("lists").alias("list")))
        pairs = sum(int(index.size[r["list"]]) * r["count"] for r in visits.groupBy("list").count().collect())
        report["users"] = begun.count()
        report["certified"] = report["users"] - open_.count()
        report["scored"] = pairs / max(1, report["users"] * int(index.size.sum()))
    more = _score(open_, index, seen, n, block)
    return topn_per_user(best.drop("rank").unionByName(more.drop("rank")), "score", n)
