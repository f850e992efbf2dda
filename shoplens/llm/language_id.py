"""Language identification by nearest centroid.

A text is the vector of its character n-grams (1 to 3 letters of lower-cased
words, hashed to ``DIM`` places), damped term frequency times inverse document
frequency, of length one. Each language has several centroids, found by
spherical k-means over a bounded sample of its labelled texts; a text gets the
language of the centroid with the largest cosine, and is rejected when even
that cosine is below what the centroid's own sample reaches at the text's length
(``_least``; the sample is also cut into pieces, so that short texts are judged
by short ones), or below ``MIN_COSINE``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import materialize

#: Places of the hashed n-gram vectors.
DIM = 1 << 14
#: Longest n-gram.
GRAMS = 3
#: Centroids per language.
CENTROIDS = 4
#: Labelled texts per language that the model is fitted on at most, chosen by
#: hash. The bound of the fit; predictions read every text.
SAMPLE = 1000
#: Least cosine that is accepted whatever a centroid has learned.
MIN_COSINE = 0.05
#: The learned limit: a share of this quantile of the sample's cosines.
QUANTILE, MARGIN = 0.01, 0.5
#: Characters of the pieces that each sample text is cut into besides itself.
PIECES = [8 << i for i in range(9)]
#: Classes of text length (powers of two of the number of distinct n-grams, since
#: a repeated word makes a text no longer in this sense), and cosines
#: in a class below which those of all centroids of the language count.
LENGTHS, FEW = 16, 20
UNKNOWN = "und"
#: Code points hashed at once.
PIECE = 1 << 20


def _letter_table() -> np.ndarray:
    """1 for code points that are letters, else 0; combining marks are none, so
    that words of scripts that write vowels as marks fall apart at them."""
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = True
    return table


_LETTERS: list[np.ndarray] = []


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the n-grams of a whole text; both empty when it
    has no letters. Everything between letters counts as one space."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    counts = np.zeros(DIM, np.int64)
    code = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    is_letter = _LETTERS[0][code]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.where(is_letter, code, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of several spaces stays
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
    for at in range(0, len(code), PIECE):
        part = code[at:at + PIECE + GRAMS - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, GRAMS + 1):
            h = h[:len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            last = min(len(h), PIECE)
            slot = (h[:last] * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(50)
            counts += np.bincount(slot.astype(np.int64), minlength=DIM)
    place = np.flatnonzero(counts)
    return place, counts[place]


def weights(place: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vector's values at ``place``, of length one."""
    v = (1 + np.log(count)) * idf[place]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def pieces(text: str) -> list[str]:
    """Pieces of ``PIECES`` characters from the middle of a text on, those
    that are shorter than it; to the end of a word where one ends soon."""
    out = []
    for n in PIECES:
        if 2 * n > len(text):
            break
        at = text.find(" ", (len(text) - n) // 2) + 1
        end = text.find(" ", at + n, at + n + 16)
        out.append(text[at:at + n if end < 0 else end])
    return out


def _length(count: np.ndarray) -> int:
    """The length class of a text with these n-gram counts."""
    return min(LENGTHS - 1, len(count).bit_length())


@dataclass
class Model:
    """Languages, inverse document frequencies, and centroids (rows of length
    one) with the language of each: at most languages x CENTROIDS x DIM. Of
    each centroid and length class the least cosine that is accepted."""
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    min_cosine: float = MIN_COSINE
    least: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        place, count = grams(text)
        if not len(place) or not self.langs:
            return UNKNOWN, 0.0, True
        cos = self.centroids[:, place] @ weights(place, count, self.idf)
        best = int(cos.argmax())
        score = float(min(1.0, max(0.0, cos[best])))
        learned = 0.0 if self.least is None else float(self.least[best, _length(count)])
        return self.langs[self.owner[best]], score, score < max(self.min_cosine, learned)


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-point start; rows of length one."""
    centre = x.mean(axis=0)
    picks = [centre / (np.linalg.norm(centre) or 1)]
    near = x @ picks[0]
    seeds = []
    for _ in range(min(k, len(x))):
        seeds.append(x[int(near.argmin())])
        near = np.maximum(near, x @ seeds[-1]) if len(seeds) > 1 else x @ seeds[-1]
    c = np.array(seeds)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _least(x: np.ndarray, c: np.ndarray, cut: list[list[tuple[np.ndarray, np.ndarray, int]]]) -> np.ndarray:
    """The least accepted cosine per centroid of ``c`` and length class, from
    the texts ``x`` of a language and what each of them gives (places, values,
    length class of itself and its pieces). A text's cosine to its own
    centroid is to the mean of the other members. Classes that the sample
    does not have take the limit of the next shorter ones; no class has a
    higher limit than a longer one."""
    own = (x @ c.T).argmax(axis=1)
    total = np.array([x[own == i].sum(axis=0, dtype=np.float64) for i in range(len(c))])
    reached: list[tuple[int, int, float]] = []
    for i, vectors in enumerate(cut):
        rest = total[own[i]] - x[i]
        norm = np.linalg.norm(rest)
        for place, value, length in vectors:
            cos = c[:, place] @ value
            cos[own[i]] = rest[place] @ value / norm if norm > 1e-6 else -1
            best = int(cos.argmax())
            if cos[best] >= 0:
                reached.append((best, length, float(cos[best])))
    out = np.zeros((len(c), LENGTHS))
    best, length, cos = (np.array(v) for v in zip(*reached)) if reached else (np.empty(0),) * 3
    for k in range(len(c)):
        for n in range(LENGTHS):
            some = cos[(length == n) & (best == k)]
            if len(some) < FEW:
                some = cos[length == n]
            out[k, n] = MARGIN * np.quantile(some, QUANTILE) if len(some) else out[k, n - 1] if n else 0
    return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample: int = SAMPLE, centroids: int = CENTROIDS, min_cosine: float = MIN_COSINE) -> Model:
    """Fit on ``sample`` texts per language at most, chosen by a hash of id and
    text. Rows without a language, or without letters, teach nothing. The
    vectors and the clustering of a language are made in tasks; the driver
    gets a count per language, the document frequencies (DIM) and the
    centroids.
    """
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"),
                           F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null")
    # a share of each language that leaves about twice the sample, so that what is ranked is bounded
    share = {r["lang"]: min(1.0, 2 * sample / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Model([], np.ones(DIM), np.empty((0, DIM), np.float32), np.empty(0, np.int64), min_cosine)
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    rows = rows.withColumn("h", F.xxhash64("id", "text")).where(
        F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30))
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("lang", "text")

    def vectors(batches):
        for b in batches:
            lang, place, count, cut = [], [], [], []
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, c = grams(t)
                if len(p):
                    lang.append(x), place.append(p), count.append(c), cut.append(pieces(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(place, pa.list_(pa.int64())),
                 pa.array(count, pa.list_(pa.int64())), pa.array(cut, pa.list_(pa.string()))],
                names=["lang", "place", "count", "pieces"])

    made = materialize(rows.mapInArrow(
        vectors, "lang string, place array<long>, count array<long>, pieces array<string>"), "lang-vectors")
    df = np.zeros(DIM)
    for r in made.select(F.explode("place").alias("p")).groupBy("p").count().toArrow().to_pylist():
        df[r["p"]] = r["count"]
    n = made.count()
    idf = np.log((1 + n) / (1 + df)) + 1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), DIM), np.float32)
        for i, (p, c) in enumerate(zip(pdf["place"], pdf["count"])):
            x[i, p] = weights(np.asarray(p), np.asarray(c), idf)
        order = np.lexsort(x[:, :64].T)  # independent of the order of rows
        x = x[order]
        c = _k_means(x, centroids)
        cut = []
        for i in order:
            own = [(np.asarray(pdf["place"].iloc[i]), np.asarray(pdf["count"].iloc[i]))]
            own += [g for g in map(grams, pdf["pieces"].iloc[i]) if len(g[0])]
            cut.append([(p, weights(p, n, idf), _length(n)) for p, n in own])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "c": [v.astype(np.float32).tobytes() for v in c],
                             "least": list(_least(x, c, cut))})

    found = sorted(made.groupBy("lang").applyInPandas(cluster, "lang string, c binary, least array<double>").collect())
    langs = sorted({r["lang"] for r in found})
    return Model(langs, idf, np.array([np.frombuffer(r["c"], np.float32) for r in found]).reshape(-1, DIM),
                 np.array([langs.index(r["lang"]) for r in found], np.int64), min_cosine,
                 np.array([r["least"] for r in found], np.float64).reshape(-1, LENGTHS))


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred, lang_score (cosine, 0 to 1) and
    lang_rejected; columns of these names are replaced.

    Only the text is read for a prediction. A null or empty text, and one
    without letters, is ``und`` with score 0 and rejected, as is every text
    under a model without languages. A rejected text keeps the nearest
    language in lang_pred. Texts of any length are read whole; repeated rows
    are predicted alike; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([known.value.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    text = F.col(f"`{text_col}`")
    return (docs.drop("lang_pred", "lang_score", "lang_rejected").withColumn("__lang", predict(text))
            .withColumns({"lang_pred": F.col("__lang.lang"), "lang_score": F.col("__lang.score"),
                          "lang_rejected": F.col("__lang.rejected")}).drop("__lang"))
