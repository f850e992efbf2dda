"""The corpus pipeline against the brute-force versions of its stages."""

import re
from collections import defaultdict

import corpus_pipeline
from llm_rows import edge_rows
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_fingerprint
from test_text import brute_contamination

from shoplens.llm.common import row_key
from shoplens.llm.language_id import fit


def brute_pipeline(rows, items, model, encode, key):
    rows = [(d, t) for d, t in rows if not model.predict(t)[2]]
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    rows = [rows[min(g)[3]] for g in groups.values()]
    roots = brute_components([brute_fingerprint(t) for _, t in rows], 4)
    parts = defaultdict(list)
    for (d, t), r in zip(rows, roots):
        parts[r].append((d is None, d or 0, key[t], (d, t)))
    rows = [min(p, key=lambda x: x[:3])[3] for p in parts.values()]
    clean = [(d, t) for d, t in rows if not brute_contamination([(d, t)], items, 10)[0][2]]
    return sorted((d, tuple(encode(t))) for d, t in clean)


def test_pipeline(spark, tmp_path):
    rows = edge_rows()
    docs = spark.createDataFrame([(d, t, "xx", "s", 0) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    items = [(1, " ".join(texts[9].split()[2:14])), (2, texts[402]), (3, "never seen at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    from public_tokenizers import path
    from shoplens.llm.unigram import load
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = {r.text: r.key for r in docs.select("text", row_key(F.col("text")).alias("key")).collect()}
    want = brute_pipeline(rows, items, fit(docs), load(path("piece_bpe_32k.model")).encode, key)
    assert got == want and 0 < len(want) < len(rows)


def test_one_of_each_simhash_group_stays(spark, tmp_path):
    """Near copies without ids, near copies that share the smallest id, repeated rows."""
    words = [f"w{i}" for i in range(300)]
    near = [" ".join(words[:i] + ["other"] + words[i + 1:]) for i in (20, 90, 150, 220)]
    far = " ".join(f"x{i}" for i in range(50))
    rows = [(None, near[0]), (None, near[1]), (7, near[2]), (7, near[3]), (7, near[3]), (9, far), (None, far[:-4] + " y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash(spark, docs, str(tmp_path)).collect()]
    roots = brute_components([brute_fingerprint(t) for _, t in rows], 4)
    assert len(got) == len(set(roots)) and [d for d, _ in got if d is not None] in ([7, 9], [9, 7])
    nameless = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    assert corpus_pipeline.simhash(spark, nameless, str(tmp_path)).count() == len(
        set(brute_components([brute_fingerprint(t) for t in near], 4)))


def test_stages_keep_columns_and_take_empty_input(spark, tmp_path):
    schema = "doc_id long, text string, lang string, key string, uid int, node string, extra double"
    docs = spark.createDataFrame([(1, "some words here", "xx", "k", 1, "n", 0.5), (2, None, None, None, None, None, None),
                                  (1, "some words here", "xx", "k", 1, "n", 0.5)], schema)
    spark.createDataFrame([(1, "no match")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            assert n <= df.count()
            if name != "sentencepiece":
                assert out.columns == docs.columns
                assert out.select(F.col("extra")).count() == n
    assert corpus_pipeline.exact(spark, docs, str(tmp_path)).count() == 2


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
