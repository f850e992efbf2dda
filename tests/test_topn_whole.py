"""Top-n over embeddings against brute force over all pairs."""

import numpy as np
import pytest

from paths import SF01
from shoplens.operators import recommend as R
from shoplens.operators.ivf import build_index, ivf_topn


def _unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _brute(uid, uv, pid, pv, seen, n):
    cos = np.round(_unit(uv) @ _unit(pv).T, 10)
    out = {}
    for i, u in enumerate(uid):
        if uv[i].any():
            every = sorted((-cos[i, j], p) for j, p in enumerate(pid) if pv[j].any() and (u, p) not in seen)
            if every:
                out[u] = [p for _, p in every[:n]]
    return out


def _lists(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.rank)):
        got.setdefault(r.user_id, []).append(r.product_id)
    return got


def _embeddings(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    side = {s: [r for r in rows if (r.vec_id % 10 == 0) == s] for s in (True, False)}
    u, p = side[True], side[False]
    return ([r.vec_id for r in u], np.array([r.embedding for r in u], float),
            [r.vec_id for r in p], np.array([r.embedding for r in p], float))


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_topn(spark, block):
    """Ties, repeated seen pairs, ids past 2^53, vectors without a direction, users who have seen (nearly) all."""
    rng = np.random.default_rng(4)
    big = 1 << 60
    uid, pid = [big + i for i in range(12)], [big + j for j in range(90)]
    uv, pv = rng.standard_normal((12, 8)), rng.standard_normal((90, 8))
    pv[20:50] = pv[20]
    uv[3], pv[7] = 0.0, 0.0
    seen = {(u, p) for u in uid for p in pid if (u * 31 + p) % 17 == 0}
    seen |= {(uid[5], p) for p in pid[2:]} | {(uid[6], p) for p in pid}
    users = spark.createDataFrame([(u, v.tolist()) for u, v in zip(uid, uv)], "user_id long, vector array<double>")
    prods = spark.createDataFrame([(p, v.tolist()) for p, v in zip(pid, pv)], "product_id long, vector array<double>")
    pairs = spark.createDataFrame(sorted(seen) * 2, "user_id long, product_id long")
    assert _lists(R.exact_topn(users, prods, pairs, n=10, block=block).collect()) == _brute(uid, uv, pid, pv, seen, 10)
    assert _lists(R.exact_topn(users, prods, n=95, block=block).collect()) == _brute(uid, uv, pid, pv, set(), 95)
    assert R.exact_topn(users.limit(0), prods, pairs).count() == 0
    assert R.exact_topn(users, prods.limit(0), pairs).count() == 0
    summary = {r.user_id: (r.scored, r.best) for r in R.score_summary(users, prods, block).collect()}
    best = (_unit(uv) @ _unit(pv).T).max(axis=1)
    assert set(summary) == set(uid) - {uid[3]} and all(summary[u] == (89, pytest.approx(b)) for u, b in
                                                      zip(uid, best) if u != uid[3])


def _frames(spark, uid, uv, pid, pv, seen):
    return (spark.createDataFrame([(u, v.tolist()) for u, v in zip(uid, uv)], "user_id long, vector array<double>"),
            spark.createDataFrame([(p, v.tolist()) for p, v in zip(pid, pv)], "product_id long, vector array<double>"),
            spark.createDataFrame(sorted(seen), "user_id long, product_id long"))


@pytest.mark.parametrize("block", [4096, 9])
def test_inverted_file_is_exact_and_scores_little(spark, block):
    """Clustered vectors: all users are certified or settled by a few lists."""
    rng = np.random.default_rng(7)
    middle = rng.standard_normal((20, 24))
    uid, pid = list(range(30)), list(range(1000, 1600))
    uv = middle[np.arange(30) % 20] + 0.15 * rng.standard_normal((30, 24))
    pv = middle[np.arange(600) % 20] + 0.15 * rng.standard_normal((600, 24))
    pv[40:60] = pv[40]  # one product vector repeated
    uv[3], pv[7] = 0.0, 0.0
    seen = {(u, p) for u in uid for p in pid if (u * 31 + p) % 17 == 0} | {(uid[5], p) for p in pid[3:]}
    report = {}
    got = _lists(ivf_topn(*_frames(spark, uid, uv, pid, pv, seen), n=10, probes=2, lists=20, block=block,
                          report=report).collect())
    assert got == _brute(uid, uv, pid, pv, seen, 10)
    assert report["users"] == 29 and report["certified"] >= 25 and report["scored"] < 0.25


def test_inverted_file_without_structure(spark):
    """Uniform vectors, few products, no products, no users, many lists."""
    rng = np.random.default_rng(8)
    uid, pid = list(range(8)), list(range(100, 180))
    uv, pv = rng.standard_normal((8, 16)), rng.standard_normal((80, 16))
    users, prods, pairs = _frames(spark, uid, uv, pid, pv, {(0, 100), (99, 101)})
    want = _brute(uid, uv, pid, pv, {(0, 100)}, 5)
    assert _lists(ivf_topn(users, prods, pairs, n=5).collect()) == want
    assert _lists(ivf_topn(users, prods, pairs, n=5, lists=80, probes=1).collect()) == want
    assert _lists(ivf_topn(users, prods, n=100).collect()) == _brute(uid, uv, pid, pv, set(), 100)
    assert ivf_topn(users.limit(0), prods, pairs).count() == 0 == ivf_topn(users, prods.limit(0)).count()
    index = build_index(prods, lists=6)
    assert index.rows.count() == 80 == index.size.sum() and (index.near <= index.far).all()


def test_registered_topn_finds_the_true_best(spark):
    import __spark_entry__ as E
    uid, uv, pid, pv = _embeddings(spark)
    seen = {(p - p % 10, p) for p in pid}
    want = _brute(uid, uv, pid, pv, seen, 10)
    assert _lists(E.queries()["recommend_topn"](spark, SF01).collect()) == want
    cos = _unit(uv) @ _unit(pv).T
    got = {r.user_id: (r.scored, r.best) for r in E.queries()["cross_score"](spark, SF01).collect()}
    assert got == {u: (len(pid), pytest.approx(c.max(), abs=2 ** -20)) for u, c in zip(uid, cos)}
    routed = {(r.user_id, r.product_id) for r in E.queries()["recommend_routing"](spark, SF01).collect()
              if r.source == "recommender"}
    assert routed and all(p in want[u] for u, p in routed)


def test_routing_lists_products_for_every_user(spark):
    """Customers, event users and user vectors, not the user vectors alone."""
    import __spark_entry__ as E
    from shoplens.plans.q_clean import clean
    want = {r[0] for r in spark.read.parquet(f"{SF01}/customer.parquet").select("c_custkey").collect()}
    want |= {r[0] for r in clean(spark, SF01).select("user_id").distinct().collect()}
    want |= {r[0] for r in spark.read.parquet(f"{SF01}/embeddings.parquet").where("vec_id % 10 = 0").select("vec_id").collect()}
    got = E.queries()["recommend_routing"](spark, SF01).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in got} == dict.fromkeys(want - {None}, 10)
