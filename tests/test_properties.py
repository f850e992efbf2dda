"""Properties of the operators on the fixture data and brute-force checks of
the exact candidate-generation joins."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF001
from shoplens.operators import clean as C
from shoplens.operators import features as FE
from shoplens.operators import recommend as R
from shoplens.operators import search as S
from shoplens.sources.fixtures import shop


def test_dedup_idempotent(spark):
    d = C.drop_duplicates(shop(spark, SF001))
    assert d.count() == C.drop_duplicates(d).count()
    assert C.find_duplicates(d).count() == 0


def test_no_negative_prices_after_clean(spark):
    c = C.clean_events(shop(spark, SF001))
    assert c.filter(F.col("price") < 0).count() == 0


def test_interaction_score_bounds_and_order_independence(spark):
    raw = shop(spark, SF001)
    a = FE.interaction_table(FE.relative_price(C.clean_events(raw)))
    b = FE.interaction_table(FE.relative_price(C.clean_events(raw.repartition(7, "user_id"))))
    lo, hi = a.agg(F.min("interaction_score"), F.max("interaction_score")).first()
    assert 0.0 <= lo <= hi <= 100.0
    ra = sorted((r[0], r[1], round(r[2], 9)) for r in a.collect())
    rb = sorted((r[0], r[1], round(r[2], 9)) for r in b.collect())
    assert ra == rb


def test_normalised_rates_in_unit_interval(spark):
    p = FE.product_table(FE.relative_price(C.clean_events(shop(spark, SF001))))
    for c in FE.RATE_COLUMNS:
        lo, hi = p.agg(F.min(c), F.max(c)).first()
        assert lo is None or (0.0 <= lo <= hi <= 1.0 + 1e-12)


def test_event_shares_sum_to_one(spark):
    from shoplens.operators.analytics import event_mix, events_by, hour_of_time
    c = C.clean_events(shop(spark, SF001))
    assert abs(event_mix(c).agg(F.sum("share")).first()[0] - 1.0) < 1e-9
    h = events_by(c, hour_of_time(), "hour")
    for t in ("view", "cart", "purchase"):
        assert abs(h.agg(F.sum(f"{t}_percent")).first()[0] - 1.0) < 1e-9


def test_disjoint_user_split(spark):
    inter = FE.interaction_table(FE.relative_price(C.clean_events(shop(spark, SF001))))
    s = R.split_disjoint_users(inter)
    tr = {r[0] for r in s.filter("split = 'train'").select("user_id").distinct().collect()}
    rest = {r[0] for r in s.filter("split <> 'train'").select("user_id").distinct().collect()}
    assert not (tr & rest)
    assert s.count() == inter.count()


def test_factorize_dense_first_seen(spark):
    rows = [(i, u, f"00:00:{i:02d}") for i, u in enumerate([5, 3, 5, 9, 3, 1, 9])]
    df = spark.createDataFrame(rows, "k int, user_id long, time string").withColumn("date", F.lit("2019-10-01"))
    got = {r[0]: r[1] for r in R.factorize_ids(df.repartition(3), "user_id", ["date", "time"]).collect()}
    assert got == {5: 0, 3: 1, 9: 2, 1: 3}


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def _vocab(n=400, seed=3):
    rnd = random.Random(seed)
    letters = "abcdeilnorst"
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n)})


def test_correct_words_matches_brute_force(spark):
    vocab = _vocab()
    freq = {w: (i * 7) % 13 + 1 for i, w in enumerate(vocab)}
    rnd = random.Random(5)
    queries = [w[:-1] + "z" for w in rnd.sample(vocab, 30)] + ["zzzzzz", vocab[3]]
    bank = spark.createDataFrame(list(freq.items()), "word string, freq long")
    words = spark.createDataFrame([(q,) for q in queries], "word string")
    got = {r.word: r.corrected for r in S.correct_words(words, bank).collect()}
    for q in set(queries):
        if q in freq:
            exp = q
        else:
            c = [(d, -freq[w], w) for w in vocab for d in [_lev(q, w)] if d <= 2]
            exp = min(c)[2] if c else None
        assert got[q] == exp, q


def test_fuzzy_match_matches_brute_force(spark):
    vocab = _vocab(300, 11)
    rnd = random.Random(8)
    words = sorted(set(rnd.sample(vocab, 25) + ["notebok", "laptop"]))
    terms = sorted(set(vocab + ["notebook", "laptops"]))
    wdf = spark.createDataFrame([(w,) for w in words], "word string")
    tdf = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.word, r.term): r.ratio for r in S.fuzzy_match(wdf, tdf, 80).collect()}
    exp = {}
    for w, t in itertools.product(words, terms):
        r = round(200 * _lcs(w, t) / (len(w) + len(t)))
        if r >= 80:
            exp[(w, t)] = r
    assert got == exp
    assert got[("notebok", "notebook")] == 93


def test_route_list_is_full(spark):
    routing = spark.createDataFrame([(u, 10 - k, k) for u, k in ((1, 0), (2, 2), (3, 8), (4, 10), (5, 2))],
                                    "user_id long, random_slots int, recommender_slots int")
    prods = spark.createDataFrame([(j,) for j in range(100, 130)], "product_id long")
    rec = spark.createDataFrame([(u, 100 + k, k + 1) for u in (1, 2, 3) for k in range(12)] + [(5, 100, 1)],
                                "user_id long, product_id long, rank int")
    # 30 products, 20 seen, 10 left: each list still has ten
    seen_pairs = {(u, p) for u in (4, 5) for p in range(110, 130)}
    seen = spark.createDataFrame(sorted(seen_pairs), "user_id long, product_id long")
    by = {}
    for r in R.route_list(routing, rec, prods, seen).collect():
        by.setdefault(r.user_id, []).append((r.source, r.product_id))
    picked = {u: sum(1 for s, _ in items if s == "recommender") for u, items in by.items()}
    assert picked == {1: 0, 2: 2, 3: 8, 4: 0, 5: 1}
    for u, items in by.items():
        assert len(items) == len({p for _, p in items}) == 10
        assert not {(u, p) for _, p in items} & seen_pairs
    few = R.route_list(routing.filter("user_id = 4"), rec.limit(0), prods,
                       spark.createDataFrame([(4, p) for p in range(104, 130)], "user_id long, product_id long"))
    assert sorted(r.product_id for r in few.collect()) == [100, 101, 102, 103]  # the catalogue is exhausted


def test_event_order_matches_struct_order(spark):
    import datetime as dt
    rows = [(dt.date(2019, 10, 1), "00:00:00"), (dt.date(2019, 10, 1), "23:59:59"), (dt.date(2019, 9, 30), "12:00:00"),
            (None, "01:00:00"), (dt.date(1969, 12, 31), "10:00:00"), (dt.date(2019, 10, 1), None), (None, None)]
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "i int, date date, time string")
    by_struct = [r.i for r in df.orderBy(F.struct("date", "time")).collect()]
    by_key = [r.i for r in df.orderBy(FE.event_order()).collect()]
    assert by_struct == by_key


def test_with_scalars_matches_one_row_join(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 4)
    g = df.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    tot = g.agg(F.sum("c").alias("_t"), F.max("c").alias("_m"))
    got = sorted(tuple(r) for r in FE.with_scalars(g, tot).collect())
    exp = sorted(tuple(r) for r in g.join(tot, how="inner").collect())
    assert got == exp and all(r[2] == 50 for r in got)


def test_deletion_rows_match_variant_sets(spark):
    bank = spark.createDataFrame([("book", 3), ("a", 1), ("notebook", 2), ("aab", 5)], "word string, freq long")
    for k in (0, 1, 2):
        fast = {(r.cand, r.v) for r in S.deletion_index(bank, k).collect()}
        ref = {(r.cand, r.v) for r in bank.select(
            F.col("word").alias("cand"), F.explode(S.deletion_variants(F.col("word"), F.lit(k))).alias("v")).collect()}
        assert fast == ref


def test_fuzzy_match_long_words(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (28, 30, 33, 36) for _ in range(3)]
    terms = []
    for w in words:
        for k in (1, 4, 9):
            t = list(w)
            for _ in range(k):
                if rnd.random() < 0.5:
                    t.insert(rnd.randrange(len(t)), rnd.choice("abcdxyz"))
                else:
                    t.pop(rnd.randrange(len(t)))
            terms.append("".join(t))
    got = {(r.word, r.term): r.ratio for r in S.fuzzy_match(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(t,) for t in terms], "term string"), 80).collect()}
    exp = {(w, t): round(200 * _lcs(w, t) / (len(w) + len(t))) for w, t in itertools.product(words, terms)}
    assert got == {k: v for k, v in exp.items() if v >= 80}


def test_find_duplicates_lists_every_member(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, None), (None, None), (None, None)], "x int, y string")
    got = sorted(map(str, C.find_duplicates(df).collect()))
    assert len(got) == 5 and sum("n_copies=3" in r for r in got) == 3


def test_left_join_chain_suffixes(spark):
    a = spark.createDataFrame([(1, 10, 5)], "u int, p int, v int")
    b = spark.createDataFrame([(1, 7)], "u int, v int")
    c = spark.createDataFrame([(10, 8, 9)], "p int, v_b int, w int")
    out = FE.left_join_chain([a, b, c], ["u", "p"], [("", "_b"), ("_x", "_y")])
    assert out.columns == ["u", "p", "v", "v_b_x", "v_b_y", "w"]
    assert tuple(out.first()) == (1, 10, 5, 7, 8, 9)


def test_exact_quantiles(spark):
    from shoplens.operators.quantiles import exact_quantiles
    rnd = random.Random(2)
    rows = [(g, rnd.choice([None, rnd.randrange(5), rnd.random() * 9])) for g in "abc" for _ in range(rnd.randrange(1, 90))]
    rows += [("one", 4.0), ("none", None), (None, 1.0)] + [("hot", float(i % 7)) for i in range(500)]
    rows = [(g, None if x is None else float(x)) for g, x in rows]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    qs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    got = {r.g: [r[c] for c in qs] for r in exact_quantiles(df, "g", "x", qs).collect()}
    exp = {}
    for g in {g for g, x in rows if g is not None and x is not None}:
        exp[g] = [float(np.percentile([x for h, x in rows if h == g and x is not None], 100 * q)) for q in qs.values()]
    assert got.keys() == exp.keys()
    assert all(np.allclose(got[g], exp[g]) for g in exp)


@pytest.mark.parametrize("bins,few", [(2, 1), (1024, 1 << 16)])
def test_quantiles_refine_histograms(spark, monkeypatch, bins, few):
    """Many rounds: wide and narrow ranges, hot values, infinities, neighbours of one double."""
    from shoplens.operators import quantiles as Q
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "FEW", few)
    rnd = random.Random(5)
    near = [float(np.nextafter(1.0, 2.0)), 1.0, float(np.nextafter(1.0, 0.0))]
    groups = {
        "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(60)],
        "hot": [0.0] * 300 + [rnd.random() for _ in range(20)],
        "near": near * 3 + [5.0],
        "ends": [float("-inf"), float("inf"), -1.0, 2.0, 3.0, float("inf"), float("-inf"), 0.0, -0.5],
        "two": [7.0, 9.0], "one": [1e-320]}
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    rnd.shuffle(rows)
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: [r[c] for c in qs] for r in Q.exact_quantiles(df, "g", "x", qs).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs = sorted(xs)
        for v, q in zip(got[g], qs.values()):
            at = q * (len(xs) - 1)
            a, b = xs[math.floor(at)], xs[math.ceil(at)]
            assert v == a if a == b else v == pytest.approx(a + (b - a) * (at - int(at)), rel=1e-12), (g, q)


def test_clean_events_de_duplicates_once(spark):
    """One exchange of whole rows in the cleaning plan; repeats change nothing."""
    raw = shop(spark, SF001)
    once = sorted(map(str, C.clean_events(raw).collect()))
    assert once == sorted(map(str, C.clean_events(raw.unionByName(raw)).collect()))
    for keep in ("first", "last"):
        steps = C.split_datetime(C.drop_session_duplicates(C.fill_brand(C.split_category_code(
            C.drop_neg_price(C.drop_duplicates(raw.select(*C.RAW_COLUMNS))))), keep))
        assert sorted(map(str, C.clean_events(raw, keep).collect())) == sorted(map(str, steps.collect()))


def test_strict_user_table(spark):
    e = FE.relative_price(C.clean_events(shop(spark, SF001))).filter("user_id % 3 <> 0 or event_type <> 'view'")
    plain = {r.user_id: r for r in FE.user_interaction(e).collect()}
    strict = {r.user_id: r for r in FE.user_interaction(e, strict=True).collect()}
    assert any(r.views == 0 for r in plain.values())
    for u, r in plain.items():
        assert strict[u] == r if r.views else all(not v for k, v in strict[u].asDict().items() if k != "user_id")


def test_sorting_entries_are_in_order(spark):
    import __spark_entry__ as E
    q = E.queries()
    order = {"customer_journey": None, "product_journey": None, "price_history": ("product_id", "event_time", "price"),
             "order_by_search_rank": ("query_id", "rank")}
    for name, key in order.items():
        rows = q[name](spark, SF001).collect()
        cols = key or {"customer_journey": ("user_session", "date", "time"), "product_journey": ("product_id", "date", "time")}[name]
        cols = [c for c in cols if c in rows[0].asDict()]
        got = [tuple((r[c] is not None, r[c]) for c in cols) for r in rows]
        assert got == sorted(got), name


def test_no_cartesian_product_in_plans(spark):
    import __spark_entry__ as E
    for name in ("recommend_topn", "recommend_routing", "cross_score", "fuzzy_match", "correct_spelling", "als_model",
                 "als_topn"):
        df = E.queries()[name](spark, SF001)
        df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
