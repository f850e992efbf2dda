"""The catalogue and its words: each text is moved once, words come without array lambdas."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from paths import SF001
from shoplens.functions.text import text_clean
from shoplens.operators import catalog as K
from shoplens.operators import search as S
from shoplens.sources.fixtures import catalog, name_queries


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture()
def shuffled(spark):
    """Joins of tables that are too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_catalogue_texts_are_moved_once(shuffled):
    raw = catalog(shuffled, SF001)
    assert _exchanges(K.clean_offers(raw)) == 2  # one per side of the join with the documents
    assert _exchanges(K.product_table(K.split_category(raw))) == 3
    twice = raw.unionByName(raw)
    assert sorted(map(str, K.clean_catalog_rows(twice).collect())) == sorted(map(str, K.clean_catalog_rows(raw).collect()))


def test_index_moves_the_words_once(shuffled):
    words = shuffled.createDataFrame([("p1", "red", 2), ("p1", "a", 1), ("p2", "red", 1), ("p2", "hat", 3),
                                      (None, "hat", 1)], "product_id string, word string, n long")
    idf = shuffled.createDataFrame([("red", 2, 1.5), ("hat", 1, 2.0)], "term string, df long, idf double")
    index, _ = S.index_from_words(words, None, idf=idf)
    assert _exchanges(index) == 3  # both sides of the join, one by product
    got = {(r.product_id, r.term): r.weight for r in index.collect()}
    norm = (1.5 ** 2 + 6.0 ** 2) ** 0.5
    assert got == {("p1", "red"): pytest.approx(1), ("p2", "red"): pytest.approx(1.5 / norm),
                   ("p2", "hat"): pytest.approx(6 / norm)}


def _clean(text):
    """The definition of a cleaned text without contractions, character by character."""
    kind = unicodedata.category
    kept = [c for c in text.lower() if kind(c) != "Nd" and not (c.isascii() and 32 < ord(c) < 127 and not c.isalnum())]
    words = "".join(c if kind(c)[0] in "LN" else " " for c in kept).split(" ")
    return " ".join(w for w in words if w and all("a" <= c <= "z" for c in w))


def test_clean_texts_and_words(spark):
    rng = random.Random(3)
    parts = list("abzBZ  \"._-019½Ⅷéß中😀٣\n\t") + ["\U0001d49c", " it ", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, t string")
    out = df.select("id", text_clean("t").alias("description"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.description for r in out.collect()}
    assert got == {i: _clean(t) for i, t in enumerate(texts)} | {-1: None}
    words = S.explode_text(out, "id")
    assert "lambda" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.word) for r in words.collect()) == sorted(
        (i, w) for i, t in enumerate(texts) for w in _clean(t).split(" ") if w)
    assert spark.createDataFrame([("He's here, WON'T they'd",)], "t string").select(
        text_clean(F.col("t"))).first()[0] == "he is here will not they would"


def test_reviewers_without_moving_texts(shuffled, tmp_path):
    from shoplens.plans import q_catalog as Q
    sf = str(tmp_path)
    part = [(k, f"name {k}", "Brand#1", "LARGE TIN", k % 50 + 1) for k in (1, 2, 3, 15, 20, 20, 40)] + [(None, "x", "b", "t", 1)]
    docs = [(1, "one"), (1, "other"), (1, "one"), (2, None), (2, None), (20, ""), (20, "late"), (None, "lost")]
    shuffled.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
                             ).write.parquet(f"{sf}/part.parquet")
    shuffled.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    cols = [c for c in Q.rows(shuffled, sf).columns if c != "about_product"]
    slim = Q.reviews(shuffled, sf)
    assert "about_product" not in slim.columns
    assert sorted(map(str, slim.select(cols).collect())) == sorted(map(str, Q.rows(shuffled, sf).select(cols).collect()))
    # the texts end below the first exchange
    plan = K.clean_offers(catalog(shuffled, sf, digest=True))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "sha2" in line]
    assert moved and all("Project" in line for line in moved)
    assert plan.rindex("sha2") > plan.rindex("Exchange hashpartitioning(_pid")


def test_texts_are_not_broadcast(spark, tmp_path):
    """However small the files of the documents look to the optimizer."""
    sf = str(tmp_path)
    part = [(1, "Red Hat"), (2, "Hat"), (2, "Hat"), (3, None), (4, "Cap"), (None, "Lost")]
    docs = [(1, "A Scarlet thing, worn outside"), (1, "no"), (2, None), (4, ""), (9, "elsewhere"), (None, "nowhere")]
    spark.createDataFrame([(k, n, "Brand#1", "LARGE TIN", 3) for k, n in part],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    asked, raw = name_queries(spark, sf), catalog(spark, sf)
    for df in (asked, raw, catalog(spark, sf, digest=True)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    # the words of the texts are taken below the exchange
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("regexp_extract") > plan.rindex("Exchange hashpartitioning(doc_id")
    assert sorted(map(tuple, asked.collect()), key=str) == sorted(
        [(1, "red hat scarlet"), (1, "red hat"), (2, "hat"), (2, "hat"), (3, ""), (4, "cap"), (None, "lost")], key=str)
    assert sorted((r.product_id, r.about_product) for r in raw.where("product_id is not null").collect() if r.about_product) == [
        ("B000000001", "A Scarlet thing, worn outside"), ("B000000001", "no")]
