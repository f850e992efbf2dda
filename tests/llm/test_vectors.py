"""Clustering and whitening of vectors against plain integer arithmetic."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from shoplens.llm import bit_whitening as W
from shoplens.llm import simplex_clusters as S

SCHEMA = "vec_id long, embedding array<float>, cluster string, n int, q int"


def vector_rows(dim=64, n=300, seed=2):
    """Groups of near and of equal vectors, repeated rows and ids, vectors to be left out."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dim))
    rows = [(i, (middle[i % 6] + 0.3 * rng.standard_normal(dim)).astype("f4").tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]  # a third of all rows is one vector
    rows += [(5, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (7000, [0.0] * dim), (7001, [-0.0] * dim)]
    bad = rows[9][1]
    rows += [(2000, None), (2001, []), (2002, bad[:-1] + [None]), (2003, bad[:-1] + [float("nan")]),
             (2004, bad[:-1] + [float("inf")]), (2005, bad[:-1]), (2006, bad + [1.0])]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# -- clustering -------------------------------------------------------------

def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if whole(v) and len(v) == dim]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(),
                                        np.array(r[1], "<i4").tobytes()))
    centres = [list(v) for _, v in first[:k]]
    memo = {}
    def near(v):
        key = tuple(v)
        if key not in memo:
            memo[key] = min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
        return memo[key]
    for _ in range(rounds):
        memo.clear()
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs)]
    memo.clear()
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centres


@pytest.mark.parametrize("dim,k,rounds", [(64, 8, 10), (2, 3, 4), (1, 8, 2), (16, 1, 3), (8, 5, 0)])
def test_clusters(spark, dim, k, rounds):
    rows = vector_rows(dim, 90 if dim < 64 else 240)
    done, centroids = S.simplex_clusters(table(spark, rows), k=k, rounds=rounds, dim=dim)
    want, centres = brute_clusters(rows, k, rounds, dim)
    got = [tuple(r) for r in done.collect()]
    assert Counter(got) == want
    cs = sorted(centroids.collect())
    assert [c.centroid for c in cs] == centres
    for c in cs:
        own = [d for _, j, d in got if j == c.cluster]
        assert (c["size"], c.cluster_inertia, c.inertia) == (len(own), sum(own), sum(d for _, _, d in got))


def test_few_and_no_vectors(spark):
    rows = vector_rows(4, 12)[:3]
    done, centroids = S.simplex_clusters(table(spark, rows), dim=4)
    assert sorted(tuple(r)[1:] for r in done.collect()) == [(0, 0), (1, 0), (2, 0)] and centroids.count() == 3
    for none in ([], [(1, None), (2, [1.0])]):
        done, centroids = S.simplex_clusters(table(spark, none), dim=4)
        assert done.columns == ["vec_id", "cluster", "distance"] and done.count() == 0 and centroids.count() == 0
    same = [(i, [0.5, 0.25]) for i in range(20)]
    done, _ = S.simplex_clusters(table(spark, same), dim=2)
    assert {tuple(r)[1:] for r in done.collect()} == {(0, 0)}


def test_bounds_hold_and_filter():
    """The nearest centroid is never out, and most others are where there are clusters."""
    rng = np.random.default_rng(1)
    for dim, spread in ((64, 0.2), (64, 3.0), (3, 0.01), (2, 1.0)):
        middle = rng.standard_normal((8, dim))
        x = np.floor(1024 * (middle[rng.integers(0, 8, 3000)] + spread * rng.standard_normal((3000, dim)))).astype(int)
        x[:500] = x[500:1000]
        centres = np.floor(1024 * middle).astype(int)
        simplex = S.choose_pivots(x[:64])
        apex, top = S.apexes(x, simplex), S.apexes(centres, simplex)
        exact = np.stack([S.squared(x, c) for c in centres], axis=1)
        left = S.candidates(apex, top)
        assert left[np.arange(len(x)), exact.argmin(axis=1)].all()
        cluster, taken = S.nearest(x, apex, centres, top)
        assert (cluster == exact.argmin(axis=1)).all()
        if spread == 0.2:
            assert taken < 0.1 * exact.size


def test_apexes_of_any_pivots():
    """Equal, collinear and few pivots, huge entries."""
    rng = np.random.default_rng(3)
    flat = np.zeros((64, 5), int)
    line = np.outer(np.arange(64), [3, 1, 4, 1, 5])
    huge = rng.integers(-S.LARGEST, S.LARGEST, (64, 5))
    for sample in (flat, line, huge, np.vstack([huge[:3], line]), huge[:1]):
        simplex = S.choose_pivots(sample)
        x = np.vstack([sample, rng.integers(-2000, 2000, (200, 5)), huge])
        centres = x[::40]
        exact = np.stack([S.squared(x, c) for c in centres], axis=1)
        cluster, _ = S.nearest(x, S.apexes(x, simplex), centres, S.apexes(centres, simplex))
        assert (cluster == exact.argmin(axis=1)).all()


# -- whitening --------------------------------------------------------------

def brute_whiten(rows, components=4):
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if whole(v) and v]
    fit = set(x for _, x in kept)
    dim = max(Counter(len(x) for x in fit).items(), key=lambda p: (p[1], p[0]))[0]
    fit, kept = [x for x in fit if len(x) == dim], [(i, x) for i, x in kept if len(x) == dim]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(a, n) for a in s]
    centred = [[a - m for a, m in zip(x, mean)] for x in fit]
    v = [[sum(r[i] * r[j] for r in centred) / n if i <= j else 0 for j in range(dim)] for i in range(dim)]
    v = np.array([[float(v[min(i, j)][max(i, j)]) for j in range(dim)] for i in range(dim)])
    e, axes = np.linalg.eigh(v)
    return kept, n, s, e[::-1], axes[:, ::-1], np.trace(v)


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_whiten(spark, dim):
    rows = vector_rows(dim, 100)
    rows[3] = (3, [1e6] + rows[3][1][1:])  # a wide dimension
    kept, n, s, e, axes, trace = brute_whiten(rows)
    got = W.whiten(table(spark, rows)).collect()
    k = min(4, dim)
    assert len(got) == k * len(kept)
    deviation = Counter((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in kept)
    white = {}
    for i, x in kept:
        c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        white[i, sum((n * a - b) ** 2 for a, b in zip(x, s))] = c @ axes[:, :k] / np.sqrt(e[:k])
    for c in range(1, k + 1):
        own = [r for r in got if r.component == c]
        assert Counter((r.vec_id, int(r.deviation)) for r in own) == deviation
        mine = np.array([r.whitened for r in own])
        want = np.array([white[r.vec_id, int(r.deviation)][c - 1] for r in own])
        sign = 1 if np.abs(mine - want).max() < np.abs(mine + want).max() else -1
        assert np.abs(sign * mine - want).max() < 1e-6
        assert all(r.n == n and abs(r.explained - e[c - 1] / trace) <= 1e-9 for r in own)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_scatter_is_exact():
    rng = random.Random(4)
    for top in (0, 1, 200, 1 << 20, 1 << 50):
        for n in (1, 63, 64, 65, 300):
            x = np.array([[rng.randint(-top, top) if j else 7 for j in range(5)] for _ in range(n)], np.int64)
            sums, cross = W.block_scatter(x)
            rows = x.tolist()
            assert sums.tolist() == [sum(r[i] for r in rows) for i in range(5)]
            assert cross.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]
            assert W.squares(x) == [sum(v * v for v in r) for r in rows]
            assert all((np.frombuffer(p, f"<i{p[0]}", offset=1) == r).all() for p, r in zip(map(W.pack, x), x))


def test_no_variance(spark):
    got = W.whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(got) == 15 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (1, 0, None, None, None)}
    got = W.whiten(table(spark, [(i, [float(i % 2), 2.0, 3.0]) for i in range(6)])).collect()
    assert {(r.component, r.n, r.whitened is None, r.explained) for r in got} == {
        (1, 2, False, 1.0), (2, 2, True, 0.0), (3, 2, True, 0.0)}
    assert {abs(r.whitened) for r in got if r.component == 1} == {1.0}
    for none in ([], [(1, None), (2, [None]), (3, [])]):
        out = W.whiten(table(spark, none))
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_registered(spark):
    import __spark_entry__ as E
    from paths import SF01
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = E.queries()["op12_bit_whitening"](spark, SF01).collect()
    kept, n, s, e, _, trace = brute_whiten(rows)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in kept}
    assert len(got) == 4 * len(kept) and all(r.deviation == want[r.vec_id] and r.n == n for r in got)
    assert all(abs(r.explained - e[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-6 for r in got)
    want, centres = brute_clusters(rows, 8, 10, 64)
    got = E.queries()["op11_simplex_clusters"](spark, SF01).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert {(r.cluster, r.centroid_sha256) for r in got} <= {
        (j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centres)}
