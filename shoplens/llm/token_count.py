"""Token counts from a pre-token dictionary, without token ids.

A piece model whose pieces carry the white-space marker only in front never
joins text across a marker that follows another character, so a text falls
into pre-tokens that count independently. Each distinct pre-token of the
corpus is counted once by the library; the counts are then joined to the
pre-token frequencies of each document and summed.

The join has two exact halves. Common pre-tokens -- those above a frequency
chosen so that at most ``HEAD`` of at most ``HEAD_CHARS`` characters qualify --
are a broadcast of bounded size; all others are joined in a shuffle. No
pre-token is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import keyed, materialize

MARKER = "▁"
#: Bound of the broadcast dictionary: entries, and characters of an entry.
HEAD, HEAD_CHARS = 1 << 19, 48
_RUNS = re.compile(" +[^ ]*")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first marker; markers are
    written as spaces. The empty text has none."""
    if not text:
        return []
    if MARKER in text:
        text = text.replace(MARKER, " ")
    parts = text.split(" ")
    if "" in parts:  # runs of spaces belong together
        parts = [run[1:] for run in _RUNS.findall(" " + text)]
    return parts


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner = re.compile(f"[^{MARKER}]{MARKER}")
    if any(inner.search(model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError("pieces of this model span pre-tokens")
    return model


def count_pieces(path: str, keys: list[str]) -> list[int]:
    """Pieces of each pre-token: those it adds behind another one."""
    model = _model(path)
    guard = len(model.encode("a"))
    return [len(ids) - guard for ids in model.encode(["a " + k for k in keys], num_threads=1)]


def _frequencies(batches):
    for b in batches:
        seen = Counter()
        for t in b.column(0).to_pylist():
            seen.update(pretokens(t or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["pretoken", "n"])


def token_dictionary(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, freq, pieces) for every distinct pre-token, written once."""
    def counted(batches):
        for b in batches:
            pieces = count_pieces(model_path, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int64())],
                                             names=["pretoken", "freq", "pieces"])

    freq = (docs.select(F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(_frequencies, "pretoken string, n long")
            .groupBy("pretoken").agg(F.sum("n").alias("freq")))
    return materialize(freq.mapInArrow(counted, "pretoken string, freq long, pieces long"), "token-dictionary")


def _head_threshold(dictionary: DataFrame, head: int) -> float:
    """Smallest frequency such that at most ``head`` pre-tokens reach it:
    from a histogram in steps of 2^(1/8), at most some 500 rows."""
    step = F.floor(F.log2("freq") * 8)
    hist = dictionary.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, float("inf")
    for row in hist:
        total += row["count"]
        if total > head:
            break
        least = row["step"]
    return least


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 head: int = HEAD) -> DataFrame:
    """One row per input row: uid, doc_id, n_bytes, n_tokens.

    Null and empty texts have no bytes and no tokens. Repeated rows and rows
    that share an id are counted on their own; a null id stays null. Texts of
    any length are counted whole; an empty table gives no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    dictionary = token_dictionary(docs, model_path, text_col)
    least = _head_threshold(dictionary, head)
    common = (F.floor(F.log2("freq") * 8) >= F.lit(least)) & (F.length("pretoken") <= HEAD_CHARS)
    top = dictionary.where(common).select("pretoken", "pieces").toArrow()
    known = spark.sparkContext.broadcast(
        dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def per_document(batches):
        get = known.value.get
        for b in batches:
            uid, doc, size, key, num = [], [], [], [], []
            for u, d, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total, rest = 0, Counter()
                parts = pretokens(t or "")
                for p, n in zip(parts, map(get, parts)):
                    if n is None:
                        rest[p] += 1
                    else:
                        total += n
                # the row's own entry: no pre-token holds a marker, so it joins nothing
                uid.append(u), doc.append(d), size.append(len((t or "").encode()))
                key.append(f"{MARKER}{u}"), num.append(total)
                k = len(rest)
                uid.extend([u] * k), doc.extend([None] * k), size.extend([None] * k)
                key.extend(rest.keys()), num.extend(rest.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(doc, b.schema.field(1).type), pa.array(size, pa.int64()),
                 pa.array(key, pa.string()), pa.array(num, pa.int64())],
                names=["uid", "doc_id", "n_bytes", "pretoken", "n"])

    rows = keyed(docs, id_col, text_col)
    rows = rows.mapInArrow(per_document, f"uid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                         "n_bytes long, pretoken string, n long")
    tail = dictionary.where(~common).select("pretoken", "pieces")
    return (rows.join(tail, "pretoken", "left")
            .groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")))
