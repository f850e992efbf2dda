"""Language ID against plain dictionaries: n-grams, weights, centroids, choice and score."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from shoplens.llm import language_id as L

MASK = (1 << 64) - 1


def brute_grams(text):
    """slot -> count of the 1- to 3-grams; runs of other than letters are one space."""
    marked = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower())
    marked = " ".join(marked.split())
    if not marked:
        return {}
    marked = f" {marked} "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i:i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) * 0xC2B2AE3D27D4EB4F) & MASK
            out[(h * 0xFF51AFD7ED558CCD & MASK) >> 50] += 1
    return out


def brute_vector(counts, idf):
    v = {p: (1 + math.log(c)) * idf[p] for p, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {p: x / norm for p, x in v.items()}


def test_against_dictionaries(spark):
    rnd = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "äöüßpqrs"}
    def text(lang, n):
        return " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(2, 7))) for _ in range(n))
    rows = [(i, text(lang, rnd.choice([3, 30, 120])), lang) for i, lang in enumerate(list(letters) * 15)]
    rows += [(100, None, "aa"), (101, "12 34", "bb"), (102, text("aa", 20), None)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))

    taught = [(brute_grams(t), lang) for _, t, lang in rows if lang and brute_grams(t)]
    df = Counter(p for counts, _ in taught for p in counts)
    idf = [math.log((1 + len(taught)) / (1 + df[p])) + 1 for p in range(L.DIM)]
    assert np.allclose(model.idf, idf)
    vectors = [(brute_vector(c, idf), lang) for c, lang in taught]

    def cosine(centroid, v):
        return sum(float(centroid[p]) * x for p, x in v.items())

    for lang in letters:  # each centroid is the mean direction of the texts that are nearest to it
        own = [k for k in range(len(model.owner)) if model.langs[model.owner[k]] == lang]
        assert 1 <= len(own) <= L.CENTROIDS
        members = {k: [] for k in own}
        for v, x in vectors:
            if x == lang:
                members[max(own, key=lambda k: cosine(model.centroids[k], v))].append(v)
        for k, vs in members.items():
            mean = np.zeros(L.DIM)
            for v in vs:
                for p, x in v.items():
                    mean[p] += x
            assert np.allclose(model.centroids[k], mean / np.linalg.norm(mean), atol=1e-5)

    texts = [t for _, t, _ in rows] + ["", "?!", "zz yy xx", "a", text("bb", 400), "AbC ÄÖ"] + [text("cc", n) for n in (1, 2, 9)]
    got = {r.id: r for r in L.classify(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        counts = brute_grams(t)
        if not counts:
            assert (got[i].lang_pred, got[i].lang_score, got[i].lang_rejected) == (L.UNKNOWN, 0.0, True)
            continue
        cos = [cosine(c, brute_vector(counts, idf)) for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert got[i].lang_score == pytest.approx(min(1.0, max(0.0, cos[best])), abs=1e-5)
        assert cos[[model.langs[o] for o in model.owner].index(got[i].lang_pred)] <= cos[best]
        if sorted(cos)[-1] - sorted(cos)[-2] > 1e-5:
            assert got[i].lang_pred == model.langs[model.owner[best]]
            limit = max(L.MIN_COSINE, model.least[best][min(L.LENGTHS - 1, len(counts).bit_length())])
            if abs(cos[best] - limit) > 1e-5:
                assert got[i].lang_rejected == (cos[best] < limit)
