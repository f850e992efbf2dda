"""The ranked searches over whole query sets, against plain Python, and what their plans move."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shoplens.operators import catalog as K
from shoplens.operators import search as S
from shoplens.plans import q_search as Q
from shoplens.plans import stages
from shoplens.sources.fixtures import catalog

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
NAMES = ["Red Hat", "Red Cap", "Blue Hat", "Green Scarf", None]


@pytest.fixture()
def sf(spark, tmp_path):
    """Parts with and without a text, some twice, some texts on several parts."""
    part = [(k, NAMES[k % 5], f"Brand#{k % 3}", "LARGE", k % 7) for k in range(1, 70)]
    part += [(200, "Red Hat", "Brand#1", "LARGE", 3)] * 2 + [(100, "Cap", "Brand#1", "SMALL", 3), (None, "Hat", "Brand#1", "SMALL", 3)]
    texts = [(k, "worsted felt " * (k % 4) + f"item{'abcdefgh'[k % 8]} woollen") for k in range(1, 40)]
    texts += [(200, "felt of felt"), (200, "a late one"), (100, None), (None, "lost")]
    folder = str(tmp_path)
    spark.createDataFrame(part, PART).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def brute_ranking(docs, queries, top):
    """{query_id: [(product_id, similarity)]} of all products by cosine."""
    tf = {}
    for product, text in docs:
        tf.setdefault(product, Counter()).update(w for w in text.split() if len(w) >= 2)
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vectors = {p: unit(c) for p, c in tf.items()}
    out = {}
    for q, text in queries:
        v = unit(Counter(re.findall(r"\w{2,}", text.lower())))
        s = {p: sum(x * d[t] for t, x in v.items() if t in d) for p, d in vectors.items()}
        out[q] = sorted(((p, x) for p, x in s.items() if x > 0), key=lambda r: (-round(r[1], 10), r[0]))[:top]
    return out


def test_every_query_is_ranked(spark, sf):
    q = E.queries()
    docs = [(r.product_id, r.description) for r in q["build_description"](spark, sf).collect()]
    corr = [(r.query_id, r.corrected) for r in q["correct_spelling"](spark, sf).collect() if r.query_id is not None]
    assert {i for i, _ in corr} > set(range(1001, 1070))
    want = {i: hits for i, hits in brute_ranking(docs, set(corr), 50).items() if hits}
    got = {}
    for r in q["tfidf_query"](spark, sf).distinct().collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.product_id, r.similarity)
    assert set(got) == set(want) and len(got) > 60
    for i, hits in want.items():
        assert [got[i][k + 1][0] for k in range(len(hits))] == [p for p, _ in hits], i
        assert [got[i][k + 1][1] for k in range(len(hits))] == pytest.approx([s for _, s in hits], abs=1e-6)
    above = {(i, k + 1, p) for i, hits in want.items() for k, (p, s) in enumerate(hits) if s > 0.1}
    for name in ("search_result", "search_result_join", "order_by_search_rank"):
        assert {(r.query_id, r["rank"], r.product_id) for r in q[name](spark, sf).collect()} == above, name
    stages.forget()


def test_index_moves_and_writes_no_text_twice(spark, sf):
    """The index is made of words that are taken where the texts lie by product id; no
    table of texts is written."""
    stages.forget()
    E.queries()["tfidf_index"](spark, sf).collect()
    built = {name for _, folder, name in stages._MEMO if folder == sf}
    assert built == {"first_ids", "doc_words", "idf", "tfidf_index"}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.doc_words(Q.passing_docs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 3  # parts, texts, names and ids
    stages.forget()


def test_products_of_first_ids_are_the_product_table(spark, sf):
    raw = catalog(spark, sf)
    slim = K.explode_reviewers(K.clean_offers(catalog(spark, sf, digest=True)))
    rows = K.explode_reviewers(K.clean_offers(K.of_first_ids(raw, K.first_ids(slim))))
    want = K.product_table(K.explode_reviewers(K.clean_offers(raw)))
    got = K.first_products(rows)
    assert got.columns == want.columns and want.count() > 40
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # texts of one id, names without value, names shared by ids
    cols = [c for c in K.PRODUCT_COLUMNS if c not in ("product_id", "product_name")]
    odd = spark.createDataFrame([("p2", "a", "x"), ("p1", "a", "z"), ("p1", "a", "b"), ("p1", "a", None), ("p3", None, "n"),
                                 ("p2", None, "m"), ("p3", "c", "c")], "product_id string, product_name string, about_product string")
    odd = odd.select("*", *[F.lit("v").alias(c) for c in cols if c != "about_product"])
    kept = K.of_first_ids(odd, K.first_ids(odd))
    assert kept.count() == 5
    assert sorted(map(str, K.first_products(kept).collect())) == sorted(map(str, K.product_table(odd).collect()))


def test_blocks_are_scored_in_chunks_without_shuffling_pairs(spark, monkeypatch):
    """Many equal products over several blocks, string ids, few queries at a time."""
    rnd = random.Random(4)
    words = [f"w{'abcdefghij'[i]}" for i in range(10)]
    data = [(f"B{i:04}", " ".join(rnd.choice(words[:4]) for _ in range(2))) for i in range(300)]
    data += [(f"C{i:04}", " ".join(rnd.choice(words) for _ in range(30))) for i in range(100)]
    docs = spark.createDataFrame(data, "product_id string, description string")
    index, idf = S.index_from_words(S.doc_words(docs), docs.agg(F.count(F.lit(1)).alias("_n")))
    texts = ["wa wb", "wa", "wc wd wj", "wj", "wi wh wg", "none", "wb wb wa"]
    corrected = spark.createDataFrame(list(enumerate(texts)), "query_id long, corrected string")
    monkeypatch.setattr(S, "CHUNK", 3)
    for block in (16, 1000):
        postings, blocks = S.block_postings(index, block=block)
        if block == 16:
            assert postings.select("block").distinct().count() > 10
        got = S.rank_queries(corrected, idf, (postings, blocks), 50)
        want = brute_ranking(data, list(enumerate(texts)), 50)
        found = {}
        for r in got.collect():
            found.setdefault(r.query_id, {})[r["rank"]] = r.product_id
        assert found == {q: {k + 1: p for k, (p, _) in enumerate(hits)} for q, hits in want.items() if hits}
    plan = S.rank_queries(corrected, idf, (postings, blocks), 50)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum((qweight" not in plan


def test_one_term_does_not_fill_one_block(spark):
    """Products with one heaviest term, in a class that fills several blocks."""
    data = [(i, f"t{i}", 1) for i in range(400)] + [(i, "red", 9) for i in range(400)]
    words = spark.createDataFrame(data, "product_id long, word string, n long")
    index, _ = S.index_from_words(words, words.agg(F.count_distinct("product_id").alias("_n")))
    postings, _ = S.block_postings(index.withColumn("peak_term", F.lit("red")), block=50)
    assert postings.select("block").distinct().count() == 1  # alike, in blocks of fewer products than ALIKE
    old, S.ALIKE = S.ALIKE, 2
    try:
        postings, _ = S.block_postings(index, block=50)
    finally:
        S.ALIKE = old
    sizes = [r.n for r in postings.where("term = 'red'").groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) >= 4 and max(sizes) < 200


def test_only_variants_of_unknown_words_are_shuffled(spark):
    rnd = random.Random(5)
    bank = spark.createDataFrame([("".join(rnd.choice("abcdefgh") for _ in range(9)), i) for i in range(400)] + [("worthless", 7)],
                                 "word string, freq long")
    words = spark.createDataFrame([("wrthless",), ("worthless",), ("zzzzzzzzz",)], "word string")
    found = S.correct_words(words, bank)
    assert {r.word: r.corrected for r in found.collect()} == {"wrthless": "worthless", "worthless": "worthless", "zzzzzzzzz": None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_slot" in plan
