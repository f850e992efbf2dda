"""Line de-duplication of long words and scripts without spaces, against brute
force over all positions of a line."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from shoplens.llm.line_dedup import line_dedup, shingles

UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")


def starts(line, size=12):
    """Positions from which ``size`` characters are a shingle."""
    for word in re.finditer(r"\S+", line, re.ASCII):
        whole = len(word[0]) > size or any(unicodedata.name(c, "").startswith(UNSPACED) for c in word[0])
        yield from range(word.start(), word.end() if whole else word.start() + 1)


def brute(lines, similarity=0.8):
    sets = [{x[i:i + 12] for i in starts(x)} for x in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def lines():
    rnd = random.Random(6)
    script = {name: [chr(c) for c in range(a, b) if unicodedata.category(chr(c)) == "Lo"]
              for name, a, b in (("khmer", 0x1780, 0x17B4), ("lao", 0xE81, 0xEAF), ("burmese", 0x1000, 0x1021),
                                 ("tibetan", 0xF40, 0xF6A))}
    out = ["https://example.com/" + "a" * 30, "https://example.org/" + "b" * 30, "https://example.com/item/1?q=x",
           "https://example.com/item/1?q=y&z=other-page-of-the-shop", "/usr/local/share/lib/one", "/usr/local/share/man/two",
           "a" * 12, "a" * 13, "a" * 12 + "b", "identifier_of_a_first_thing", "identifier_of_a_second_thing",
           "deadbeefcafe0123456789abcdef", "deadbeefcafefedcba9876543210", "short words only here", "short words only there"]
    for letters in script.values():
        text = "".join(rnd.choice(letters) for _ in range(300))
        other = "".join(rnd.choice(letters) for _ in range(200))
        # a near copy, one with the same start alone, and short runs of the same letters
        out += [text, text[:150] + text[151:], text[:40] + other, text[:6] + " " + text[20:26], text[:6] + " " + text[40:46]]
    url = "https://shop.example.com/" + "".join(rnd.choice("abcdef0123456789/") for _ in range(400))
    return out + [url, url[:-5], url[::-1], url[:25] + other]


def test_shingles_cover_each_character(spark):
    data = lines() + ["é" * 20 + " ab 漢字abc x", "", "  lead", "🙂" * 14 + " y"]
    got = spark.createDataFrame([(x,) for x in data], "line string").select(
        "line", shingles(F.col("line")).alias("s")).collect()
    for r in got:
        assert r.s == [r.line[i:i + 12] for i in starts(r.line)]


def test_lines_of_long_words(spark):
    data = lines()
    got = line_dedup(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)).collect()
    want = brute(data)
    assert {r.doc_id: r.keep_id for r in got} == dict(enumerate(want))
    assert want[1] == 1 and len(set(want)) < len(want)
