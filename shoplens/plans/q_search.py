"""Registered queries: text cleaning, index, spelling, scoring, ranking and
result policy (SURVEY 2.7, 2.8, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.text import text_clean
from shoplens.operators import catalog as K
from shoplens.operators import search as S
from shoplens.plans.q_catalog import products
from shoplens.plans.registry import register
from shoplens.sources import files
from shoplens.sources.fixtures import catalog, name_queries, search_queries


def docs(spark, sf):
    """Products with their cleaned description, as a shared stage."""
    from shoplens.plans.stages import shared
    return shared(spark, sf, "docs", lambda: S.build_description(products(spark, sf)))


def first_ids(spark, sf):
    """The name and id of every product, a stage made without moving texts."""
    return _stage(spark, sf, "first_ids", lambda: K.first_ids(
        K.explode_reviewers(K.clean_offers(catalog(spark, sf, digest=True)))))


def passing_docs(spark, sf):
    """The rows of ``docs`` for one reader: nothing is written, and the texts move
    once, to where they lie by product id."""
    raw = K.of_first_ids(catalog(spark, sf), first_ids(spark, sf))
    return S.build_description(K.first_products(K.explode_reviewers(K.clean_offers(raw))))


def all_queries(spark, sf):
    """The literal queries (ids 1-4) and one query per catalogue product
    name (ids 1000 + part key)."""
    named = name_queries(spark, sf).select((F.col("query_id") + 1000).alias("query_id"), "text")
    return search_queries(spark).unionByName(named)


#: The query set of topk_similarity, search_policy and fuzzy_match: the literal queries and the parts divisible by 100.
ASKED = "query_id < 1000 or query_id % 100 = 0"


def _stage(spark, sf, name, build):
    from shoplens.plans.stages import shared
    return shared(spark, sf, name, build)


def index_tables(spark, sf):
    """Index-time artefacts, built once per catalogue: the inverted index (with
    the largest weight of each product) and the idf table."""
    words = word_table(spark, sf)
    n_docs = first_ids(spark, sf).agg(F.count(F.lit(1)).alias("_n"))
    idf = _stage(spark, sf, "idf", lambda: S.index_from_words(words, n_docs)[1])
    index = _stage(spark, sf, "tfidf_index", lambda: S.index_from_words(words, n_docs, idf=idf)[0])
    return index, idf


def word_table(spark, sf):
    """The words of each document, an index-time stage. Rows of one word lie
    together in a file, as they take the least room so when they are shuffled."""
    return _stage(spark, sf, "doc_words", lambda: S.doc_words(passing_docs(spark, sf)).sortWithinPartitions("word"))


def bank_table(spark, sf):
    """The word bank, an index-time stage that needs neither the words of each
    document nor the index."""
    return _stage(spark, sf, "word_bank", lambda: S.word_bank(docs(spark, sf)))


def corrected(spark, sf):
    """All queries and their corrected texts; the word bank comes from the words
    of each document, which the searches need anyway."""
    bank = _stage(spark, sf, "word_bank", lambda: S.bank_from_words(word_table(spark, sf)))
    return _stage(spark, sf, "corrected_queries", lambda: S.correct_spelling(all_queries(spark, sf), bank))


def _pipeline(spark, sf):
    index, idf = index_tables(spark, sf)
    return word_table(spark, sf), index, idf, corrected(spark, sf)


def ranked(spark, sf, asked=None):
    """The best 50 products of every query, or of those that ``asked`` leaves.
    The stage that all entries share has them once per corrected text."""
    corr = corrected(spark, sf).where(asked or "true")

    def build():
        index, idf = index_tables(spark, sf)
        return S.rank_texts(corr, idf, S.block_postings(index), 50)

    return S.hits_of(corr, _stage(spark, sf, "ranked_asked" if asked else "ranked", build))


def synonyms(spark, sf):
    """The lemma and the mined synonyms of every word, an index-time stage."""
    return _stage(spark, sf, "synonyms", lambda: S.mine_synonyms(docs(spark, sf), bank_table(spark, sf)))


@register("text_clean", ["cat_products"], f"""
 select product_id, {__import__('shoplens.plans.oracle', fromlist=['x']).text_clean_sql('about_product')} as clean_text
 from cat_products""")
def q_text_clean(spark, sf):
    return products(spark, sf).select("product_id", text_clean("about_product").alias("clean_text"))


@register("build_description", ["docs"], "select product_id, description from docs")
def q_build_description(spark, sf):
    return S.build_description(products(spark, sf)).select("product_id", "description")


@register("word_bank", ["bank"], "select * from bank")
def q_word_bank(spark, sf):
    return S.word_bank(docs(spark, sf))


@register("vocab_union", ["bank"], "select word from bank")
def q_vocab_union(spark, sf):
    return S.vocab_union(docs(spark, sf))


@register("explode_text", ["docs"], """
 select product_id, word, count(*) as n from (select product_id, unnest(string_split(description, ' ')) as word
  from docs) where length(word) > 0 group by all""")
def q_explode_text(spark, sf):
    return S.explode_text(docs(spark, sf)).groupBy("product_id", "word").agg(F.count(F.lit(1)).alias("n"))


@register("sink_word_bank", ["bank"], "select word from bank")
def q_sink_word_bank(spark, sf):
    path = files.fresh_path(spark, "word-bank")
    files.write_word_bank(S.word_bank(docs(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("word"))


@register("src_word_bank", ["bank"], "select word from bank")
def q_src_word_bank(spark, sf):
    """A vocabulary file with padding, blank lines and repeated words."""
    path = files.fresh_path(spark, "word-file")
    words = S.vocab_union(docs(spark, sf))
    padded = words.select(F.concat(F.lit(" "), "word", F.lit("  ")).alias("word"))
    words.unionByName(padded).unionByName(words.select(F.lit("").alias("word"))).write.text(path)
    return files.read_word_bank(spark, path)


@register("tfidf_index", ["idx"], "select * from idx", floats=["weight"])
def q_tfidf_index(spark, sf):
    return index_tables(spark, sf)[0].select("product_id", "term", "tf", "weight")


@register("lowercase_query", ["qs"], "select query_id, lower(text) as query from qs")
def q_lowercase_query(spark, sf):
    return all_queries(spark, sf).select("query_id", F.lower("text").alias("query"))


@register("correct_spelling", ["corr"], "select * from corr")
def q_correct_spelling(spark, sf):
    return corrected(spark, sf)


@register("tfidf_query", ["ranked_all"], "select * from ranked_all where rank <= 50", floats=["similarity"])
def q_tfidf_query(spark, sf):
    return ranked(spark, sf)


@register("topk_similarity", ["ranked"], "select * from ranked where rank <= 10", floats=["similarity"])
def q_topk_similarity(spark, sf):
    return ranked(spark, sf, ASKED).where("rank <= 10")


@register("search_result", ["ranked_all", "docs"], """
 select r.query_id, r.rank, r.similarity, d.* from ranked_all r join docs d on r.product_id = d.product_id
 where r.rank <= 50 and r.similarity > 0.10""",
          floats=["similarity", "discounted_price", "actual_price", "discount_percentage", "rating", "rating_count"])
def q_search_result(spark, sf):
    d = passing_docs(spark, sf)
    r = S.search_result(ranked(spark, sf), d, 0.10)
    return r.select("query_id", "rank", "similarity", *d.columns)


@register("search_result_join", ["ranked_all", "docs"], """
 select r.query_id, r.rank, r.product_id, d.product_name from ranked_all r join docs d on r.product_id = d.product_id
 where r.rank <= 50 and r.similarity > 0.10""")
def q_search_result_join(spark, sf):
    return S.search_result(ranked(spark, sf), first_ids(spark, sf), 0.10).select(
        "query_id", "rank", "product_id", "product_name")


@register("order_by_search_rank", ["ranked_all"], """
 select query_id, rank, product_id from ranked_all where rank <= 50 and similarity > 0.10""")
def q_order_by_search_rank(spark, sf):
    return ranked(spark, sf).filter(F.col("similarity") > 0.10).select("query_id", "rank", "product_id").orderBy("query_id", "rank")


@register("search_policy", ["corr", "ranked"], """
 select c.query_id, c.query, c.corrected, coalesce(h.hits, 0) as hits, c.query <> c.corrected as instead,
  coalesce(h.hits, 0) > 0 and coalesce(h.hits, 0) < 10 as less_accurate, coalesce(h.hits, 0) = 0 as no_results
 from corr c left join (select query_id, count(*) as hits from ranked where rank <= 50 and similarity > 0.10
  group by query_id) h on c.query_id = h.query_id where c.query_id < 1000 or c.query_id % 100 = 0""")
def q_search_policy(spark, sf):
    corr = corrected(spark, sf)
    res = ranked(spark, sf, ASKED).filter(F.col("similarity") > 0.10)
    return S.search_policy(corr.where(ASKED), res, 50)


@register("expand_query", ["qwords", "lemmas", "synonyms"], """
 with syn as (select lemma, string_agg(synonym, ' ' order by synonym) as syns from synonyms group by lemma)
 select query_id, string_agg(concat_ws(' ', coalesce(l.lemma, q.word), s.syns), ' ' order by pos) as expanded
 from qwords q left join lemmas l on q.word = l.token left join syn s on s.lemma = l.lemma group by query_id""")
def q_expand_query(spark, sf):
    return S.expand_query(all_queries(spark, sf), synonyms(spark, sf))


@register("fuzzy_match", ["qwords", "bank"], """
 with w as (select distinct word from qwords where length(word) > 0 and (query_id < 1000 or query_id % 100 = 0)),
 p as (select w.word, b.word as term, length(w.word) as la, length(b.word) as lb from w join bank b
  on least(length(w.word), length(b.word)) * 400 >= 159 * (length(w.word) + length(b.word))),
 v as (select *, list_reduce(
   list_transform(string_split(term, ''), lambda c: list_sum(list_transform(range(la),
     lambda i: case when substr(word, (i + 1)::int, 1) = c then 1::hugeint << i::int else 0 end))::hugeint),
   lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::hugeint << la) - 1), (1::hugeint << la) - 1) as v from p),
 r as (select word, term, la + lb as total, la - bit_count(v) as lcs from v)
 select word, term, round_even(200.0::double * lcs / total, 0)::int as ratio from r where 400 * lcs >= 159 * total""")
def q_fuzzy_match(spark, sf):
    d = docs(spark, sf)
    words = S.split_queries(all_queries(spark, sf).where(ASKED)).select("word")
    terms = S.vocab_union(d).withColumnRenamed("word", "term")
    return S.fuzzy_match(words, terms, 80)
