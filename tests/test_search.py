"""Stems, mined synonyms, pruned ranking and bit-parallel matching against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplens.functions.stem import STEPS, stem
from shoplens.operators import search as S


# Words of the published algorithm's examples and their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agree",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubling": "trouble", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "operator": "oper",
    "formaliti": "formal", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "controll": "control",
    "as": "as", "42s": "42s", "s": "s", "": "", "élans": "élans"}


def test_stem(spark):
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", stem("w").alias("s")).collect()}
    assert got == STEMS | {"sky": got["sky"]}  # y counts as a vowel
    assert spark.createDataFrame([(None,)], "w string").select(stem("w")).first()[0] is None
    for step in STEPS:  # of two suffixes the longer is tried first
        ends = [s for s, _, _ in step]
        assert all(a == b or not b.endswith(a) for i, a in enumerate(ends) for b in ends[i + 1:])


def brute_synonyms(texts, n, reach, least, lemma):
    pairs = Counter()
    for t in texts:
        ws = [lemma[w] for w in t.split()]
        for i, a in enumerate(ws):
            for b in ws[i + 1:i + 1 + reach]:
                pairs[min(a, b), max(a, b)] += 1
    own = Counter()
    for (a, b), k in pairs.items():
        own[a] += k
        if a != b:
            own[b] += k
    total, out = sum(pairs.values()), {}
    for a in own:
        near = [(k / own[b], k, b) for (x, y), k in pairs.items() for b in ({x, y} - {a} if a in (x, y) else ())
                if k >= least and k * total > own[a] * own[b]]
        out[a] = [b for *_, b in sorted(near, key=lambda p: (-p[0], -p[1], p[2]))[:n]]
    return out


def test_mined_synonyms_grow_with_the_corpus(spark):
    rnd = random.Random(3)
    words = ["gear", "gears", "bolt", "bolts", "wheel", "wheels", "wheeling", "red", "blue", "of"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40))) for _ in range(60)] + ["", "pin", "pin axle " * 9]
    docs = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)], "product_id long, description string")
    bank = S.word_bank(docs)
    rows = S.lemmas(bank).collect()
    lemma = {r.token: r.lemma for r in rows}
    freq = {r.word: r.freq for r in bank.collect()}
    assert len({lemma[w] for w in ("wheel", "wheels", "wheeling")}) == 1
    assert lemma["gears"] == min(("gear", "gears"), key=lambda w: (-freq[w], w))
    got = S.mine_synonyms(docs, bank, n=3, reach=2, least=4).collect()
    want = brute_synonyms(texts, 3, 2, 4, lemma)
    for token in lemma:
        assert {r.synonym for r in got if r.token == token} - {None} == set(want.get(lemma[token], [])), token
    queries = spark.createDataFrame([(1, "Pin gears unheard"), (2, "")], "query_id long, text string")
    out = {r.query_id: r.expanded for r in S.expand_query(queries, S.mine_synonyms(docs, bank, least=4)).collect()}
    assert out[1].startswith("pin axle ") and out[1].endswith(" unheard")
    assert S.mine_synonyms(docs.limit(0), bank.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_over_several_words(spark):
    """Bit vectors of one to five words, carries between them, other scripts, empty strings."""
    rnd = random.Random(1)
    rows = [("", ""), ("", "a"), ("a" * 130, "a" * 130), ("ab" * 90, "ba" * 40), ("🙂é日" * 30, "日🙂")]
    for n in (1, 30, 61, 62, 63, 124, 125, 300):
        for letters in ("ab", "abcdefgh", "aé日🙂"):
            rows += [("".join(rnd.choice(letters) for _ in range(n)),
                      "".join(rnd.choice(letters) for _ in range(rnd.randrange(90)))) for _ in range(3)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for r in df.select("a", "b", S.lcs_length("a", "b").alias("n")).collect():
        assert r.n == lcs(r.a, r.b), (r.a, r.b)


@pytest.mark.parametrize("block", [4, 32])
def test_pruned_ranking_is_the_full_ranking(spark, block):
    """Short and long descriptions, common and rare terms, ties, queries with
    few, many and no hits."""
    rnd = random.Random(6)
    common = [f"c{i}x" for i in range(12)]
    data = [(i, " ".join(rnd.choice(common) for _ in range(4)) + f" rare{i % 90}") for i in range(400)]
    data += [(1000 + i, " ".join(rnd.choice(common + [f"word{rnd.randrange(300)}"]) for _ in range(150))) for i in range(400)]
    data += [(3000 + i, data[0][1]) for i in range(30)]
    docs = spark.createDataFrame(data, "product_id long, description string")
    words = S.doc_words(docs)
    index, idf = S.index_from_words(words, docs.agg(F.count(F.lit(1)).alias("_n")))
    texts = [data[i][1] for i in range(0, 40, 4)] + ["c1x", "c2x c3x word7", "rare5", "nothing", ""]
    corrected = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[0])], "query_id long, corrected string")
    for top in (5, 50, 2000):
        report = {}
        got = S.rank_queries(corrected, idf, S.block_postings(index, block=block), top, report=report).collect()
        want = S.rank_queries(corrected, idf, index, top).collect()
        def rows(found):
            return sorted((r.query_id, r["rank"], r.product_id, round(r.similarity, 9)) for r in found)
        assert rows(got) == rows(want)
        assert report["joined"] <= report["all"]
        if top == 5:
            assert report["joined"] < 0.5 * report["all"]


def test_spelling_never_broadcasts_the_deletion_variants(spark):
    """The optimizer sizes the variants as the words they are made of."""
    words = spark.createDataFrame([("wrthless",), ("zzzz",), ("ering",)], "word string")
    bank = spark.createDataFrame([("worthless", 3), ("erring", 2), ("bring", 5)], "word string, freq long")
    found = S.correct_words(words, bank)
    assert {r.word: r.corrected for r in found.collect()} == {"wrthless": "worthless", "zzzz": None, "ering": "bring"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join [v#" in plan and "BroadcastHashJoin [v#" not in plan


def test_fuzzy_candidates_are_verified_by_all_cores(spark):
    words = spark.createDataFrame([("worthless",), ("bring",)], "word string")
    terms = spark.createDataFrame([("wrthless",), ("ring",), ("zebra",)], "term string")
    found = S.fuzzy_match(words, terms)
    assert {(r.word, r.term, r.ratio) for r in found.collect()} == {("worthless", "wrthless", 94), ("bring", "ring", 89)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_ranked_search_broadcasts_nothing_as_long_as_the_corpus(spark):
    bank = spark.createDataFrame([("red", 3), ("hat", 2)], "word string, freq long")
    words = spark.createDataFrame([("p1", "red", 2), ("p1", "hat", 1), ("p2", "red", 1)], "product_id string, word string, n long")
    queries = spark.createDataFrame([(1, "red hat"), (2, "rod")], "query_id long, text string")
    index, idf = S.index_from_words(words, words.agg(F.count_distinct("product_id").alias("_n")))
    corr = S.correct_spelling(queries, bank)
    ranked = S.rank_queries(corr, idf, S.block_postings(index), 5)
    plain = S.rank_queries(corr, idf, index, 5)
    for df in (index, ranked, plain, S.search_policy(corr, ranked), S.search_result(ranked, words.select("product_id"))):
        assert "BroadcastHashJoin [word" not in (plan := df._jdf.queryExecution().executedPlan().toString())
        assert not any(f"BroadcastHashJoin [{k}" in plan for k in ("term", "qtext", "query_id", "product_id"))
    assert {(r.query_id, r.product_id, r.rank) for r in ranked.collect()} == {(1, "p1", 1), (1, "p2", 2), (2, "p1", 2), (2, "p2", 1)}


def test_expansion_builds_no_index(spark, tmp_path):
    import __spark_entry__ as E
    from shoplens.plans import stages
    sf = str(tmp_path)
    spark.createDataFrame([(1, "Red Hat", "B", "LARGE TIN", 3), (2, "Hat", "B", "LARGE TIN", 4)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{sf}/part.parquet")
    spark.createDataFrame([(1, "red hats for redder heads"), (2, "hat")], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    got = {r.query_id: r.expanded for r in E.queries()["expand_query"](spark, sf).collect()}
    assert got[1001] == "red hat redder" and set(got) == {1, 2, 3, 4, 1001, 1002}
    built = {name for _, folder, name in stages._MEMO if folder == sf}
    assert "word_bank" in built and not built & {"doc_words", "idf", "tfidf_index"}
