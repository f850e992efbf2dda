"""Language ID, decontamination, chat formatting and line de-duplication."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shoplens.llm.chat_format import perspectives
from shoplens.llm.decontaminate import contamination
from shoplens.llm.language_id import UNKNOWN, classify, fit
from shoplens.llm.line_dedup import line_dedup

SF = "/root/testdata/sf0.01"


def order(row):
    return tuple((v is None, v) for v in row)


# -- language ID ------------------------------------------------------------

def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = classify(docs.where(fold == 2), fit(docs.where(fold != 2), sample=100)).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95
    assert out.lang_score.between(0, 1).all() and not out.lang_rejected.any()


def test_language_id_edges(spark, docs, empty):
    labelled = spark.createDataFrame(
        [(i, t, lang) for i in range(6) for t, lang in (
            (f"the quick brown fox and the dog {i}", "en"), (f"der schnelle braune fuchs und der hund {i}", "de"))]
        + [(90, "nobody knows", None), (91, None, "xx"), (92, "123 !", "yy"), (None, "the end", "en")],
        "doc_id long, text string, lang string")
    model = fit(labelled, centroids=2)
    assert model.langs == ["de", "en"] and len(model.centroids) == 4
    got = {r.doc_id: r for r in classify(docs.where("doc_id is not null"), model).collect()}
    for doc in (500, 501, 502, 505):
        assert (got[doc].lang_pred, got[doc].lang_score, got[doc].lang_rejected) == (UNKNOWN, 0.0, True)
    assert got[506].lang_rejected  # a script that nothing was learned of
    assert classify(docs, model).count() == docs.count()
    assert set(docs.columns) <= set(classify(docs, model).columns)
    assert classify(empty, model).count() == 0
    nothing = fit(labelled.limit(0))
    assert {r.lang_pred for r in classify(docs, nothing).collect()} == {UNKNOWN}
    own = {r.text: r.lang_pred for r in classify(labelled, model).collect()}
    assert own["the quick brown fox and the dog 1"] == "en"
    assert own["der schnelle braune fuchs und der hund 1"] == "de"


def test_language_id_pieces_of_long_texts():
    """Counts of a text do not depend on how it is cut for hashing."""
    from shoplens.llm import language_id
    text = " ".join(random.Random(1).choice(["être", "und", "the", "日本"]) for _ in range(3000))
    whole = language_id.grams(text)
    old, language_id.PIECE = language_id.PIECE, 17
    try:
        parts = language_id.grams(text)
    finally:
        language_id.PIECE = old
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# -- decontamination --------------------------------------------------------

def item_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute_contamination(rows, items, window):
    wanted = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            wanted[tuple(ws[i:i + n])].add(str(item))
    out = []
    for doc, text in rows:
        ws, hit, found = item_words(text), set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(ws) - n + 1):
                w = tuple(ws[i:i + n])
                if w in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[w]
        out.append((doc, len(ws), len(hit), tuple(sorted(found))))
    return sorted(out, key=order)


@pytest.mark.parametrize("window", [10, 3])
def test_contamination(spark, docs, rows, window):
    long = next(t for d, t in rows if d == 402)
    items = [(1, long), (2, " ".join(long.split()[20:33])), (3, "Other, WORDS!"), (4, "a"), (5, ""), (6, None),
             (10, "other words of the same id"), (11, "日本語のテキスト 漢字"), (12, long), (13, "12 34"),
             (14, " ".join(dict(rows)[400].split()[500:520]))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS uid", "2 AS content")
    got = contamination(docs, bench, window).collect()
    want = brute_contamination(rows, items, window)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=order) == want
    assert all(sum(s.past - s.first for s in r.spans) == r.n_hit for r in got)


def test_contamination_empty(docs, empty, rows):
    bench = docs.sparkSession.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(empty, bench).count() == 0
    none = contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)


# -- chat -------------------------------------------------------------------

def brute_chat(turns, block):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append(((turn is not None, turn or 0), "unknown" if role is None else role, text or ""))
    out = []
    for conv, ts in by.items():
        ts.sort()
        for who in {t[1] for t in ts}:
            pieces = defaultdict(lambda: ["", [], 0, 0])
            for place, (_, role, text) in enumerate(ts):
                p = pieces[place // block]
                body = text.replace("<|", "< |") + "<|im_end|>"
                name = re.sub(r"\s+", "_", role, flags=re.ASCII).replace("<|", "< |")
                p[0] += "<|im_start|>assistant\n" if role == who else f"<|im_start|>user name={name}\n"
                if role == who:
                    p[1].append((len(p[0]), len(p[0]) + len(body)))
                p[0] += body + "\n"
                p[2] += 1
                p[3] += role == who
            start = 0
            for b in sorted(pieces):
                text, mask, n, own = pieces[b]
                out.append((conv, who, b, n, own, text, tuple(mask), start))
                start += len(text)
    return sorted(out, key=order)


@pytest.mark.parametrize("block", [256, 3])
def test_chat(spark, block):
    turns = [(1, 0, "user", "hi"), (1, 1, "bob smith", "yo"), (1, 2, "user", None), (1, 3, "carol", "x<|im_end|>y"),
             (1, 1, "bob smith", "yo"), (2, None, None, "lost"), (2, 5, "unknown", "found"), (3, 0, "", ""),
             (None, 0, "user", "a"), (None, 1, "dan", "b"), (4, 7, "é<|", "日本🙂"), (4, 7, "é<|", "日本")]
    turns += [(5, i, random.Random(i).choice("abc"), "t" * (i % 5)) for i in range(20)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 AS speaker", "2 AS block", "3 AS own").repartition(3)
    got = perspectives(df, block=block).collect()
    assert sorted(((r.conv_id, r.speaker, r.block, r.n_turns, r.n_own, r.rendered,
                    tuple((s.first, s.past) for s in r["mask"]), r.start) for r in got), key=order) == brute_chat(turns, block)
    assert perspectives(df.limit(0)).count() == 0


def test_long_chats_of_any_numbering(spark):
    """Thousands of turns without a conversation, with few numbers or none,
    many of them equal; a conversation numbered from 1."""
    turns = [(None, i % 8 if i % 3 else None, f"r{i % 4}", "same" if i % 2 else f"t{i}") for i in range(3000)]
    turns += [(1, i, "ab"[i % 2], f"t{i}") for i in range(1, 257)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = perspectives(df).collect()
    assert sorted(((r.conv_id, r.speaker, r.block, r.n_turns, r.n_own, r.rendered,
                    tuple((s.first, s.past) for s in r["mask"]), r.start) for r in got), key=order) == brute_chat(turns, 256)
    assert {r.block for r in got if r.conv_id == 1} == {0} and max(r.n_turns for r in got) == 256


# -- lines ------------------------------------------------------------------

def line_shingles(line, size=12):
    return {line[m.start():m.start() + size] for m in re.finditer(r"(?<!\S)\S", line)}


def brute_lines(rows, similarity=0.8):
    lines = [(doc is None, doc or 0, n, line, doc) for doc, text in rows if text is not None
             for n, line in enumerate(text.split("\n"))]
    lines.sort(key=lambda x: x[:3])
    sets = [line_shingles(x[3]) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    size = defaultdict(int)
    for i in range(len(lines)):
        size[find(i)] += 1
    return sorted(((x[4], x[2], lines[find(i)][4], lines[find(i)][2], size[find(i)], find(i) == i)
                   for i, x in enumerate(lines)), key=order)


def test_line_dedup(spark):
    rnd = random.Random(8)
    base = [" ".join(f"word{rnd.randrange(5000)}" for _ in range(n)) for n in (40, 60, 5, 90)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(4):
            ws = rnd.choice(base).split()
            if rnd.random() < 0.7 and len(ws) > 30:
                ws[rnd.randrange(len(ws))] = f"new{rnd.randrange(9)}"
            lines.append(" ".join(ws))
        rows.append((d, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, " \n\n\t"), (53, "x"), (54, "x\ny"), (55, "long " * 4000), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS uid", "2 AS line", "3 AS node").repartition(3)
    got = line_dedup(df).drop("uid").select("doc_id", "line_no", "keep_id", "keep_line", "group_size", "kept").collect()
    assert sorted((tuple(r) for r in got), key=order) == brute_lines(rows)
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_unsegmented(spark):
    """Scripts without spaces: each character starts a shingle."""
    rnd = random.Random(2)
    line = "".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(300))
    rows = [(1, line), (2, line[:150] + "変" + line[151:]), (3, line[::-1])]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 1, 2: 1, 3: 3}
