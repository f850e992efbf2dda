"""Rows that every training-data operator must stand."""

import random

#: Column names that the operators use inside; inputs may have them too.
CLASHING = ("uid", "key", "h", "fp", "node", "pretoken", "anchor", "chunk", "block", "lang_pred", "n_tokens")


def sentence(rnd: random.Random, n: int, vocabulary: int = 60) -> list[str]:
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def edge_rows() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, repeated rows,
    rows that share an id, nulls, blanks, other scripts, a very long text."""
    rnd = random.Random(5)
    texts = [" ".join(sentence(rnd, rnd.choice([3, 20, 70, 160]), 4000)) for _ in range(40)]
    passage = " ".join(sentence(rnd, 75, 4000))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 5].replace(" ", "  ", 2)) for i in range(12)]
    rows += [(200 + i, f"{texts[i]} {passage} {texts[i + 1]}") for i in range(15)]
    for i in range(20):  # near copies of one long text
        ws = texts[7].split() + sentence(random.Random(7), 150, 4000)
        ws[rnd.randrange(len(ws))] = "changed"
        rows.append((300 + i, " ".join(ws)))
    long = " ".join(sentence(rnd, 30000, 900))
    rows += [(400, long), (401, long + " tail"), (402, passage), (403, passage), (404, passage.upper())]
    rows += [(500, None), (501, ""), (502, " \t\n "), (503, "a"), (504, "  lead  and trail  "), (505, "12 34 !?"),
             (506, "日本語のテキスト 漢字"), (507, "é à ü\nß\r\nñ\x0b\x0cx"), (508, "<|endoftext|> <s> ▁x <|im_end|>"),
             (509, "a b c\u0085d \x1c e"), (510, "x" * 9000)]
    rows += [(600, texts[0]), (600, texts[0]), (600, "other words of the same id"), (None, texts[1]), (None, None)]
    return rows


def frame(spark, data, schema="doc_id long, text string"):
    df = spark.createDataFrame(data, schema)
    for c in CLASHING:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df
