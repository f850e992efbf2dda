"""TF-IDF product search as batch Spark jobs.

The index is an inverted table (product_id, term, weight) -- not a matrix --
and search takes a *table* of queries, so many queries share one join
against the index. Spelling correction finds candidates with an exact
deletion-neighbourhood equi-join (two words within k edits share a string
reachable by at most k deletions from each), fuzzy matching with an exact
equi-join on unchanged segments; neither pairs every query word with every
vocabulary word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.operators.features import with_scalars
from shoplens.functions.stem import stem
from shoplens.functions.text import query_words, text_clean, tokens, word_rows

# The search page defaults.
DEFAULT_TOP = 50
DEFAULT_THRESHOLD = 0.10
LOW_CONFIDENCE_SHARE = 0.2
MAX_EDITS = 2
FUZZY_THRESHOLD = 80

# Slots of a broadcast filter of strings, by their hash.
SLOTS = 1 << 18

# Parameters of the mined synonyms: words apart at most, occurrences at least, synonyms of a word.
SYNONYM_REACH = 2
SYNONYM_PAIRS = 5
SYNONYMS = 2

# A query token: a maximal run of 2+ word characters (any script).
_QUERY_TOKEN = r"[\p{L}\p{N}_]{2,}"


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: tables as long as the word
    bank, the index or the query set. Files and exploded rows look smaller to
    the optimizer than the hash tables that the driver would build of them."""
    return df.hint("merge")


def _slots(df: DataFrame, col: str) -> DataFrame:
    """The slots of the strings of a column, ``SLOTS`` rows at most."""
    return df.select(F.pmod(F.xxhash64(col), F.lit(SLOTS)).alias("_slot")).distinct()


def _in_slots(df: DataFrame, col: str, slots: DataFrame) -> DataFrame:
    """The rows whose string may be one of those of ``slots``: all that are, and
    others that share a slot with them. Nothing is shuffled."""
    slot = F.pmod(F.xxhash64(col), F.lit(SLOTS))
    return df.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


# ------------------------------------------------------------ documents
def build_description(products: DataFrame, cols=("product_name", "about_product", "category_1", "category_2")) -> DataFrame:
    """Cleaned searchable text per product (whole texts)."""
    raw = F.concat_ws(" ", *[F.col(c) for c in cols])
    return products.withColumn("description", text_clean(raw))


def explode_text(docs: DataFrame, key: str = "product_id", text: str = "description") -> DataFrame:
    return word_rows(docs, key, text=text)


def word_bank(docs: DataFrame, text: str = "description") -> DataFrame:
    """Distinct words of all descriptions with their corpus frequency."""
    w = word_rows(docs, text=text)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def vocab_union(docs: DataFrame, text: str = "description") -> DataFrame:
    return word_rows(docs, text=text).distinct()


# ------------------------------------------------------------ index
def doc_words(docs: DataFrame, key: str = "product_id", text: str = "description") -> DataFrame:
    """(key, word, n): occurrences of every word in every document -- the
    one tokenisation pass of the whole texts that the word bank, document
    frequencies and the index all derive from."""
    w = word_rows(docs, key, text=text)
    return w.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def bank_from_words(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.sum("n").alias("freq"))


def index_from_words(words: DataFrame, n_docs: DataFrame, key: str = "product_id",
                     idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, idf) from the per-document word counts; terms are words of
    two or more characters. ``n_docs`` is a 1-row table (_n). Besides its own
    weight an index row has the largest of its document and the term of that."""
    tf = words.filter(F.length("word") >= 2).select(key, F.col("word").alias("term"), F.col("n").alias("tf"))
    if idf is None:
        df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = with_scalars(df_, n_docs).select(
            "term", "df", (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    # one exchange by document, of the plain columns; its terms are sorted and spilled like a join's; no document without a key
    w = tf.join(_shuffled(idf.select("term", "idf")), "term").where(F.col(key).isNotNull())
    w = w.select(key, "term", "tf", "idf").repartition(key).select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))
    whole = Window.partitionBy(key)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole))
    w = w.select(key, "term", "tf", "w", norm.alias("_norm"), F.max("w").over(whole).alias("_top"))
    first = F.min(F.when(F.col("w") == F.col("_top"), F.col("term"))).over(whole)
    index = w.select(key, "term", "tf", (F.col("w") / F.col("_norm")).alias("weight"),
                     (F.col("_top") / F.col("_norm")).alias("peak"), first.alias("peak_term"))
    return index, idf


# ------------------------------------------------------------ spelling
def _delete_one(s: Column) -> Column:
    """All strings made by deleting one character of s."""
    return F.transform(F.sequence(F.lit(1), F.length(s)),
                       lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def deletion_variants(word: Column, k) -> Column:
    """Distinct strings reachable from ``word`` by at most k deletions
    (k may be a column)."""
    if isinstance(k, int) and k <= 2:
        return _deletions_upto2(word, k)
    kk = k if isinstance(k, Column) else F.lit(int(k))
    start = F.array(word)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(kk, F.lit(1))), start,
        lambda acc, j: F.when(j <= kk, F.array_distinct(F.concat(
            acc, F.flatten(F.transform(F.filter(acc, lambda s: F.length(s) > 0), _delete_one))))).otherwise(acc))


def _deletions_upto2(w: Column, k: int) -> Column:
    """Direct form for k <= 2: the word, every single deletion and every
    pair of deletions (positions i < j), in one pass."""
    n = F.length(w)
    if k == 0:
        return F.array(w)
    singles = _delete_one(w)
    if k == 1:
        return F.array_distinct(F.concat(F.array(w), singles))
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.transform(
            F.sequence(i + 1, F.greatest(n, i + 1)),
            lambda j: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, j - i - 1),
                               F.substring(w, j + 1, n)))))
    pairs = F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(w), singles, pairs))


def deletion_rows(df: DataFrame, word: str, k: int, keep: list[str]) -> DataFrame:
    """One row (``keep``..., v) per deletion variant of ``word``, k <= 2.

    Positions come from two generators, i in 0..n and j in i..n, keeping
    (0, 0) (the word), (0, j) (delete j) and (i, j) with i < j (delete i and
    j). Plain ``explode`` + ``substring`` stay in generated code, unlike
    nested array lambdas. A word with repeated letters yields some variant
    twice; consumers de-duplicate their matches.
    """
    n = F.length(word)
    i_hi = n if k >= 2 else F.lit(0)
    j_hi = n if k >= 1 else F.lit(0)
    w = F.col(word)
    return (df.select(*keep, word, F.explode(F.sequence(F.lit(0), i_hi)).alias("_i"))
              .select(*keep, word, "_i", F.explode(F.sequence(F.col("_i"), F.greatest(j_hi, F.col("_i")))).alias("_j"))
              .filter((F.col("_j") > F.col("_i")) | (F.col("_j") == 0))
              .select(*keep, F.concat(F.substring(w, F.lit(1), F.col("_i") - 1),
                                      F.substring(w, F.col("_i") + 1, F.col("_j") - F.col("_i") - 1),
                                      F.substring(w, F.col("_j") + 1, n)).alias("v")))


def deletion_index(bank: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(v, cand, freq): every vocabulary word under each of its <= k
    deletion variants. Built once per word bank (index time) and reused by
    every spelling query."""
    if max_edits <= 2:
        return deletion_rows(bank.select(F.col("word").alias("cand"), "freq", F.col("word").alias("_w")),
                             "_w", max_edits, ["cand", "freq"])
    return bank.select(F.col("word").alias("cand"), "freq",
                       F.explode(deletion_variants(F.col("word"), max_edits)).alias("v"))


def split_queries(queries: DataFrame) -> DataFrame:
    """(query_id, pos, word): whitespace words of the lower-cased query."""
    return queries.select("query_id", F.posexplode(query_words("text")).alias("pos", "word"))


def correct_words(words: DataFrame, bank: DataFrame, max_edits: int = MAX_EDITS,
                  index: DataFrame | None = None) -> DataFrame:
    """For each distinct word: itself if it is in the word bank, else the
    bank word within ``max_edits`` Levenshtein edits with the least
    distance, then the highest frequency, then alphabetical; null when none.
    """
    w = words.select("word").distinct()
    known = w.join(_shuffled(bank.select("word")), "word", "left_semi").select("word", F.col("word").alias("corrected"))
    unknown = w.join(_shuffled(bank.select("word")), "word", "left_anti")
    uv = unknown.select("word", F.explode(deletion_variants(F.col("word"), max_edits)).alias("v"))
    if index is None:
        # only bank words within max_edits of the length of some unknown word
        # can match: an equi-join on the lengths in reach
        reach = unknown.select(F.explode(F.sequence(F.length("word") - max_edits, F.length("word") + max_edits))
                               .alias("_l")).distinct()
        band = bank.withColumn("_l", F.length("word")).join(reach, "_l", "left_semi").select("word", "freq")
        index = deletion_index(band, max_edits)
    # only variants that some unknown word may have are shuffled
    pairs = uv.join(_shuffled(_in_slots(index, "v", _slots(uv, "v"))), "v").select("word", "cand", "freq").distinct()
    scored = pairs.withColumn("dist", F.levenshtein("word", "cand", max_edits)) \
                  .filter((F.col("dist") >= 0) & (F.col("dist") <= max_edits))
    best = scored.groupBy("word").agg(
        F.min_by("cand", F.struct("dist", (-F.col("freq")).alias("nf"), "cand")).alias("corrected"))
    fixed = unknown.join(_shuffled(best), "word", "left")
    return known.unionByName(fixed)


def correct_spelling(queries: DataFrame, bank: DataFrame, max_edits: int = MAX_EDITS,
                     index: DataFrame | None = None) -> DataFrame:
    """(query_id, query, corrected): a query with any uncorrectable word
    becomes the empty string. Word order is kept with an ordered
    collect per query -- a query's own words, bounded by its text."""
    q = queries.select("query_id", F.lower("text").alias("query"))
    words = split_queries(queries)
    fix = correct_words(words, bank, max_edits, index)
    j = words.join(_shuffled(fix), "word", "left")
    per = j.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "corrected"))).alias("_w"),
        F.count_if(F.col("corrected").isNull()).alias("_bad"))
    text = F.when(F.col("_bad") > 0, F.lit("")).otherwise(
        F.array_join(F.transform("_w", lambda s: s["corrected"]), " "))
    out = q.join(_shuffled(per.select("query_id", text.alias("corrected"))), "query_id", "left")
    return out.select("query_id", "query", F.coalesce("corrected", F.lit("")).alias("corrected"))


# ------------------------------------------------------------ scoring
def query_vectors(corrected: DataFrame, idf: DataFrame, text: str = "corrected",
                  qkey: str = "query_id") -> DataFrame:
    """(qkey, term, qweight): L2-normalised tf * idf of in-vocabulary query
    terms."""
    t = corrected.select(qkey, F.explode(F.regexp_extract_all(F.lower(F.col(text)),
                                                             F.lit(_QUERY_TOKEN), 0)).alias("term"))
    tf = t.groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(_shuffled(idf.select("term", "idf")), "term").select(qkey, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(qkey).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_qn"))
    return w.join(_shuffled(norm), qkey).select(qkey, "term", (F.col("w") / F.col("_qn")).alias("qweight"))


def tfidf_scores(qvec: DataFrame, index: DataFrame, key: str = "product_id", qkey: str = "query_id") -> DataFrame:
    """Cosine similarity of every (query, product) sharing a term: join on
    term, partial-aggregated sum of products."""
    j = qvec.join(_shuffled(index.select(key, "term", "weight")), "term")
    return j.groupBy(qkey, key).agg(F.sum(F.col("qweight") * F.col("weight")).alias("similarity"))


def topk_similarity(scores: DataFrame, top: int | None = DEFAULT_TOP, key: str = "product_id",
                    qkey: str = "query_id") -> DataFrame:
    """Rank per query (similarity desc, product id asc) and keep the best
    ``top``; Spark plans a per-partition group limit before the shuffle."""
    # similarities equal up to summation-order noise rank by product id
    w = Window.partitionBy(qkey).orderBy(F.desc(F.round("similarity", 10)), F.asc(key))
    r = scores.withColumn("rank", F.row_number().over(w))
    return r if top is None else r.filter(F.col("rank") <= top)


# Products of a block of postings, on average, and products with one heaviest term that stay in one block, about.
BLOCK, ALIKE = 1 << 15, 512

# Queries that a block is scored for at once, about.
CHUNK = 1 << 18


def block_postings(index: DataFrame, key: str = "product_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(postings, blocks): the index rows with the block of their product, and
    (term, block, most, own): the largest weight and the number of postings of
    a term in a block. Neither is written: blocks follow from the index rows
    and from a row per class.

    Products of a block are alike: they have about the same largest weight
    (long texts, with low weights, are apart from short ones), and where a
    class fills several blocks, those with the same heaviest term are in the
    same ones. A block is about ``block`` products, whatever their terms.
    """
    from shoplens.session import materialize
    if "peak" not in index.columns:
        top = F.max(F.struct("weight", "term")).over(Window.partitionBy(key))
        index = materialize(index.withColumn("_top", top).select(
            "*", F.col("_top.weight").alias("peak"), F.col("_top.term").alias("peak_term")).drop("_top"), "peaks")
    index = index.withColumn("_class", F.floor(F.log2("peak") * -4).cast("int"))
    counts = materialize(index.groupBy(key).agg(F.max("_class").alias("_class")).groupBy("_class").agg(
        F.ceil(F.count(F.lit(1)) / block).alias("_n")), "classes")
    slot = F.xxhash64("peak_term", F.pmod(F.xxhash64(key), F.lit(max(1, block // ALIKE))))
    # a row per class
    postings = index.join(F.broadcast(counts), "_class").select(
        key, "term", (F.col("_class").cast("bigint") * (1 << 40) + F.pmod(slot, F.col("_n"))).alias("block"), "weight")
    return postings, block_bounds(postings)


def block_bounds(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "block").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("own"))


def best_in_block(top: int):
    """A function of (postings, terms of queries) of one block: the best ``top``
    products of each query among those that reach its ``reach``, in Arrow."""
    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([asked.schema.field("q"), postings.schema.field("key"), pa.field("similarity", pa.float64())])
        if not postings.num_rows or not asked.num_rows:
            return schema.empty_table()
        terms = pc.unique(asked.column("term"))
        code = pc.index_in(postings.column("term"), value_set=terms)
        postings = postings.append_column("code", code).filter(pc.is_valid(code))
        asked = asked.append_column("code", pc.index_in(asked.column("term"), value_set=terms)).sort_by("q")
        # products are numbered in their order, which breaks ties
        products = pc.unique(postings.column("key"))
        products = products.take(pc.sort_indices(products))
        postings = postings.append_column("place", pc.index_in(postings.column("key"), value_set=products)).sort_by("code")
        place, weight = (postings.column(c).to_numpy() for c in ("place", "weight"))
        ends = np.searchsorted(postings.column("code").to_numpy(), np.arange(len(terms) + 1))
        q, t, qweight, reach = (asked.column(c).to_numpy() for c in ("q", "code", "qweight", "reach"))
        starts = np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q))
        score, found = np.zeros(len(products)), []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for i in range(a, b):
                some = slice(ends[t[i]], ends[t[i] + 1])
                score[place[some]] += qweight[i] * weight[some]
            hit = np.flatnonzero(score >= max(reach[a], 0.0) if reach[a] > 0 else score)
            # scores are ranked to ten places
            rank = np.floor(score[hit] * 1e10 + 0.5)
            if len(hit) > top:
                least = np.partition(rank, len(hit) - top)[len(hit) - top]
                hit, rank = hit[rank >= least], rank[rank >= least]
            hit = hit[np.argsort(-rank, kind="stable")[:top]]
            found.append((np.full(len(hit), q[a]), hit, score[hit]))
            score[:] = 0.0
        q, hit, similarity = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array(q), products.take(pa.array(hit)), pa.array(similarity)], schema=schema)
    return run


def block_topn(qv: DataFrame, postings: DataFrame, blocks: DataFrame, top: int, key: str = "product_id",
               qkey: str = "query_id", report: dict | None = None) -> DataFrame:
    """The best ``top`` products of each query (numbered by a long ``qkey``) by
    cosine, with their rank, as ranking all of ``tfidf_scores`` would give them.

    A product's score in a block is at most the sum over the query's terms of
    query weight times the block's largest weight. The blocks with the largest
    bounds that hold ``top`` products are scored first; the last of their best
    scores is one that every product of the result has to reach, so of the
    other blocks only those whose bound reaches it are scored. A block is
    scored in one task for all queries that want it (``CHUNK`` at a time), so
    that no pair of a query and a product is shuffled but the best of a block.
    ``report``, if given, takes the postings of the scored pairs of query and
    block (``joined``) and of all (``all``).
    """
    from shoplens.session import materialize
    slots = _slots(qv, "term")
    postings = _in_slots(postings, "term", slots)
    bounds = qv.join(_shuffled(_in_slots(blocks, "term", slots)), "term").groupBy(qkey, "block").agg(
        F.sum(F.col("qweight") * F.col("most")).alias("bound"), F.max("own").alias("own"), F.sum("own").alias("rows"))
    before = Window.partitionBy(qkey).orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    bounds = materialize(bounds.withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0)) < top), "bounds")
    chunks = F.ceil(F.count_distinct(qkey) / CHUNK)
    chunks = max(1, qv.agg(chunks).first()[0])
    kind = postings.schema[key].dataType.simpleString()

    def scored(some):
        chunk = F.pmod(F.xxhash64(F.col(qkey)), F.lit(chunks)).cast("int").alias("chunk")
        asked = qv.join(_shuffled(some.select(qkey, "block", "reach")), qkey).select(
            "block", chunk, F.col(qkey).alias("q"), "term", "qweight", "reach")
        # a row per block
        of = postings.join(F.broadcast(some.select("block").distinct()), "block", "left_semi").select(
            "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
            F.col(key).alias("key"), "term", "weight")
        best = of.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(
            lambda a, b: best_in_block(top)(a, b), f"q long, key {kind}, similarity double")
        return best.select(F.col("q").alias(qkey), F.col("key").alias(key), "similarity")

    begun = materialize(topk_similarity(scored(bounds.where("first").withColumn("reach", F.lit(0.0))), top, key, qkey), "first-blocks")
    # scores are ranked to ten places
    reach = begun.where(F.col("rank") == top).select(qkey, (F.col("similarity") - 1e-9).alias("reach"))
    more = materialize(bounds.where("not first").join(_shuffled(reach), qkey, "left").where(
        F.col("reach").isNull() | (F.col("bound") >= F.col("reach"))).select(
        qkey, "block", "rows", F.coalesce("reach", F.lit(0.0)).alias("reach")), "more-blocks")
    if report is not None:
        report["all"] = bounds.agg(F.sum("rows")).first()[0] or 0
        report["joined"] = sum(df.agg(F.sum("rows")).first()[0] or 0 for df in (bounds.where("first"), more))
    return topk_similarity(begun.drop("rank").unionByName(scored(more)), top, key, qkey)


def rank_texts(corrected: DataFrame, idf: DataFrame, index: DataFrame | tuple[DataFrame, DataFrame],
               top: int | None = DEFAULT_TOP, key: str = "product_id", report: dict | None = None) -> DataFrame:
    """(qtext, key, similarity, rank) of each distinct corrected text, which is
    vectorised, scored against the index and ranked once, under a number.
    ``index`` is the plain index, or ``block_postings`` of it, of which only the
    blocks that can matter are scored."""
    from shoplens.session import materialize
    texts = corrected.select(F.col("corrected").alias("qtext")).distinct()
    texts = materialize(texts.withColumn("_q", F.monotonically_increasing_id()), "query-texts")
    qv = query_vectors(texts, idf, text="qtext", qkey="_q")
    if isinstance(index, tuple):
        ranked = block_topn(materialize(qv, "query-vectors"), *index, top, key, "_q", report)
    else:
        ranked = topk_similarity(tfidf_scores(qv, index, key, qkey="_q"), top, key, qkey="_q")
    return texts.join(_shuffled(ranked), "_q").select("qtext", key, "similarity", "rank")


def hits_of(corrected: DataFrame, ranked: DataFrame) -> DataFrame:
    """The ranked hits of each query id's text (identical text, identical
    result). A text shared by a huge share of the queries only makes this join
    skewed, which AQE splits."""
    ids = corrected.select("query_id", F.col("corrected").alias("qtext"))
    return ids.join(_shuffled(ranked), "qtext").drop("qtext")


def rank_queries(corrected: DataFrame, idf: DataFrame, index: DataFrame | tuple[DataFrame, DataFrame],
                 top: int | None = DEFAULT_TOP, key: str = "product_id", report: dict | None = None) -> DataFrame:
    """(query_id, key, similarity, rank) for a table of corrected queries."""
    return hits_of(corrected, rank_texts(corrected, idf, index, top, key, report))


def search_result(ranked: DataFrame, products: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  key: str = "product_id") -> DataFrame:
    """Hits strictly above the threshold joined to their product rows, in
    rank order."""
    hits = ranked.filter(F.col("similarity") > threshold)
    return hits.join(_shuffled(products), key).orderBy("query_id", "rank")


def search_policy(corrected: DataFrame, results: DataFrame, top: int = DEFAULT_TOP) -> DataFrame:
    """Per query: hits, 'instead' when the corrected text differs,
    'less accurate' below 0.2 * top hits, 'none' without hits."""
    hits = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    j = corrected.join(_shuffled(hits), "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return j.select(
        "query_id", "query", "corrected", "hits",
        (F.col("query") != F.col("corrected")).alias("instead"),
        ((F.col("hits") > 0) & (F.col("hits") < F.lit(int(LOW_CONFIDENCE_SHARE * top)))).alias("less_accurate"),
        (F.col("hits") == 0).alias("no_results"))


# ------------------------------------------------------------ expansion, fuzzy
def lemmas(bank: DataFrame) -> DataFrame:
    """(token, stem, lemma) of every word of the bank (word, freq): the lemma is
    the most frequent word with the same stem, of equally frequent ones the
    first in the alphabet."""
    w = bank.select(F.col("word").alias("token"), "freq", stem("word").alias("stem"))
    best = w.groupBy("stem").agg(F.min_by("token", F.struct((-F.col("freq")).alias("f"), "token")).alias("lemma"))
    return w.join(best, "stem").select("token", "stem", "lemma")


def near_words(docs: DataFrame, reach: int = SYNONYM_REACH, text: str = "description") -> DataFrame:
    """(a, b, n): how often two words, a before b in the alphabet or equal,
    stand at most ``reach`` words apart. As many rows before the map-side sum
    as words times ``reach``; no pairs of all words of a text."""
    t = docs.select(tokens(text).alias("_t"))
    behind = [F.slice("_t", d + 1, F.greatest(F.size("_t") - d, F.lit(0))) for d in range(1, reach + 1)]
    rows = t.select(F.explode(F.arrays_zip(F.col("_t").alias("x"), *[c.alias(f"y{d}") for d, c in enumerate(behind, 1)]))
                    .alias("p")).select("p.*")
    p = rows.select("x", F.explode(F.array(*[f"y{d}" for d in range(1, reach + 1)])).alias("y")).where("y is not null")
    return p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def mine_synonyms(docs: DataFrame, bank: DataFrame, n: int = SYNONYMS, reach: int = SYNONYM_REACH,
                  least: int = SYNONYM_PAIRS, text: str = "description") -> DataFrame:
    """(token, lemma, synonym) of every word of the bank, mined from the
    corpus: the ``n`` lemmas with the largest positive pointwise mutual
    information ln(n_ab N / (n_a n_b)) with the word's lemma, over pairs of
    words near each other (N pairs, n_a of them with a), for pairs that occur
    ``least`` times. Ties go to the more frequent pair, then by alphabet. A
    lemma without any has one row with a null synonym."""
    from shoplens.session import materialize
    words = materialize(lemmas(bank), "lemmas")
    of = words.select("token", "lemma")
    raw = near_words(docs, reach, text)
    pairs = (raw.join(of.select(F.col("token").alias("a"), F.col("lemma").alias("la")), "a")
             .join(of.select(F.col("token").alias("b"), F.col("lemma").alias("lb")), "b")
             .groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.sum("n").alias("n")))
    pairs = materialize(pairs, "near-lemmas")
    both = pairs.select("x", "y", "n").unionByName(pairs.where("x <> y").select(
        F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    alone = both.groupBy("x").agg(F.sum("n").alias("own"))
    total = pairs.agg(F.sum("n").cast("double").alias("_total"))
    j = both.where((F.col("x") != F.col("y")) & (F.col("n") >= least)).join(alone, "x").join(
        alone.select(F.col("x").alias("y"), F.col("own").alias("other")), "y")
    j = with_scalars(j, total).where(F.col("n") * F.col("_total") > F.col("own") * F.col("other").cast("double"))
    # for one lemma the order of n_ab / n_b is that of the mutual information
    w = Window.partitionBy("x").orderBy(F.desc(F.col("n") / F.col("other")), F.desc("n"), "y")
    best = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(
        F.col("x").alias("lemma"), F.col("y").alias("synonym"))
    return of.join(best, "lemma", "left").select("token", "lemma", "synonym")


def load_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(token, lemma, synonym): a CSV file of them."""
    return spark.read.option("header", True).schema("token string, lemma string, synonym string").csv(path)


def expand_query(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Each word -> its lemma followed by the lemma's synonyms (sorted);
    words without an entry stay as they are."""
    words = split_queries(queries)
    lem = synonyms.select("token", "lemma").distinct()
    syn = synonyms.groupBy("lemma").agg(F.array_sort(F.collect_set("synonym")).alias("syns"))
    j = (words.join(lem, words["word"] == lem["token"], "left")
         .withColumn("lemma", F.coalesce("lemma", "word"))
         .join(syn, "lemma", "left"))
    part = F.array_join(F.concat(F.array("lemma"), F.coalesce("syns", F.array().cast("array<string>"))), " ")
    per = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))).alias("_p"))
    return per.select("query_id", F.array_join(F.transform("_p", lambda s: s["p"]), " ").alias("expanded"))


#: Tasks a core that verify the candidates of the fuzzy match.
VERIFY_WAVES = 4

#: Bits of a word of the bit-parallel table: one below the sign bit is left for the carry of a sum.
LCS_BITS = 62


def lcs_masks(a) -> Column:
    """map<character, array<long>>: at each place of ``a`` where the character
    stands a bit, ``LCS_BITS`` places to a word. One entry per distinct
    character; computed once per string, whatever it is compared with."""
    a = F.col(a) if isinstance(a, str) else a
    n = F.length(a)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)))
    words = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / LCS_BITS), F.lit(0)).cast("int"))

    def mask(ch):
        def word(w):
            part = F.substring(a, w * LCS_BITS + 1, F.lit(LCS_BITS))
            return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), F.lit(0).cast("bigint"),
                               lambda acc, i: F.when(F.substring(part, i, F.lit(1)) == ch, acc.bitwiseOR(
                                   F.call_function("shiftleft", F.lit(1).cast("bigint"), i - 1))).otherwise(acc))
        return F.transform(words, word)

    each = F.array_distinct(chars)
    return F.map_from_arrays(each, F.transform(each, mask))


def lcs_length(a, b, masks: Column | None = None) -> Column:
    """Length of the longest common subsequence of two strings, by the
    bit-parallel table (Hyyro, "Bit-parallel LCS-length computation
    revisited", 2004): the row of the table is a bit vector in words of
    ``LCS_BITS`` bits, and a character of ``b`` moves it by one sum, whose
    carry goes from word to word. Zeros at the end count the length. ``masks``
    are ``lcs_masks(a)``, if they are there already."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if masks is None:  # bound to a name, so that it is made once
        return F.transform(F.array(lcs_masks(a)), lambda m: lcs_length(a, b, m))[0]
    full, zero = F.lit((1 << LCS_BITS) - 1), F.lit(0).cast("bigint")
    size = F.greatest(F.floor((F.length(a) - 1) / LCS_BITS) + 1, F.lit(1)).cast("int")
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: F.substring(b, i, F.lit(1)))

    def moved(v, m):
        """One word without a carry."""
        u = v.bitwiseAND(m)
        return (v + u).bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(u)))

    one = F.aggregate(chars, full, lambda v, ch: F.when(
        F.map_contains_key(masks, ch), moved(v, masks[ch][0])).otherwise(v))

    def row(v, ch):
        def word(acc, w):
            now, m = F.get(v, w), F.get(masks[ch], w)
            u = now.bitwiseAND(m)
            total = now + u + acc["carry"]
            return F.struct(F.concat(acc["row"], F.array(total.bitwiseAND(full).bitwiseOR(
                now.bitwiseAND(F.bitwise_not(u))))).alias("row"),
                F.call_function("shiftright", total, F.lit(LCS_BITS)).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("row"), zero.alias("carry"))
        next_ = F.aggregate(F.sequence(F.lit(0), size - 1), start, word)["row"]
        return F.when(F.map_contains_key(masks, ch), next_).otherwise(v)

    many = F.aggregate(F.aggregate(chars, F.array_repeat(full, size), row), F.lit(0),
                       lambda n, v: n + LCS_BITS - F.bit_count(v))
    return (F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
            .when(size == 1, F.lit(LCS_BITS) - F.bit_count(one)).otherwise(many))


def fuzzy_match(words: DataFrame, terms: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """(word, term, ratio) with ratio = round-half-even(200 * LCS / (len a +
    len b)) >= threshold (the indel-based edit ratio).

    Exact candidate generation of polynomial size: the ratio asks for an LCS
    of at least ``need``, so at most d = la + lb - 2 need characters are
    inserted or deleted; a term cut into d + 1 segments then has one that
    stands unchanged in the word, moved by at most the characters that either
    side may lose. Terms emit their segments for each word length in reach,
    words their substrings at the places in reach, and an equi-join on
    (lengths, segment number, segment) finds every qualifying pair. The
    candidates are verified by edit distance (never above d) and by the LCS.
    """
    low = (2.0 * threshold - 1) / (401.0 - 2 * threshold)  # least ratio of the lengths

    def reach(col):
        return F.sequence(F.ceil(F.length(col) * low).cast("int"), F.floor(F.length(col) / low).cast("int"))

    def need(la, lb):
        return F.ceil((F.col(la) + F.col(lb)) * (2.0 * threshold - 1) / 400.0).cast("int")

    def cut(df):
        df = df.withColumn("_need", need("la", "lb")).where(F.col("_need") <= F.least("la", "lb"))
        d = F.col("la") + F.col("lb") - 2 * F.col("_need")
        df = df.withColumn("_n", d + 1).withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        start = F.floor(F.col("seg") * F.col("lb") / F.col("_n")).cast("int")
        end = F.floor((F.col("seg") + 1) * F.col("lb") / F.col("_n")).cast("int")
        return df.withColumn("_s", start).withColumn("_m", end - start)

    keys = ["la", "lb", "seg", "text"]
    w = words.select("word").distinct().where(F.length("word") > 0)
    lengths = w.select(F.length("word").alias("la")).distinct()
    t = terms.select("term").distinct().where(F.length("term") > 0)
    t = cut(t.select("term", F.length("term").alias("lb"), F.explode(reach("term")).alias("la")).join(lengths, "la"))
    t = t.select("term", "la", "lb", "seg", F.substring("term", F.col("_s") + 1, F.col("_m")).alias("text"))
    a = cut(w.select("word", F.length("word").alias("la"), F.explode(reach("word")).alias("lb")))
    first = F.greatest(F.lit(0), F.col("_s") - (F.col("lb") - F.col("_need")))
    last = F.least(F.col("la") - F.col("_m"), F.col("_s") + (F.col("la") - F.col("_need")))
    a = a.withColumn("_f", first).withColumn("_l", last).where("_l >= _f")
    a = a.withColumn("_p", F.explode(F.sequence("_f", "_l")))
    a = a.select("word", "la", "lb", "seg", F.substring("word", F.col("_p") + 1, F.col("_m")).alias("text"))
    pairs = a.distinct().join(t, keys).select("word", "term", "la", "lb").distinct()
    bound = F.col("la") + F.col("lb") - 2 * need("la", "lb")
    # few bytes but much work a row: spread by count of cores, which coalescing by size would undo
    pairs = pairs.repartition(VERIFY_WAVES * pairs.sparkSession.sparkContext.defaultParallelism, "word", "term")
    pairs = pairs.where(F.levenshtein("word", "term") <= bound)
    w = w.select("word", lcs_masks("word").alias("_masks"))  # once per word
    pairs = pairs.join(w, "word").withColumn("lcs", lcs_length("word", "term", F.col("_masks")))
    tot = F.col("la") + F.col("lb")
    r = pairs.filter(F.lit(400) * F.col("lcs") >= F.lit(2 * threshold - 1) * tot)
    return r.select("word", "term", F.bround(F.lit(200.0) * F.col("lcs") / tot).cast("int").alias("ratio"))
