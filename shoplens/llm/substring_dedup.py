"""Substring de-duplication: seed and extend on winnowed anchors.

Seeds: in every window of ``window`` words the smallest k-gram hash is its
anchor. A repeated window has the same anchor at the same place, so joining
documents on anchors finds every repeat of at least a window. Each occurrence
of an anchor owns the run of windows whose anchor it is; the words of that run
are its block.

Extend: occurrences of an anchor with equal blocks match over the whole block
at once. Blocks of one anchor that differ match on a part of their windows
only; one occurrence of each distinct block is extended both ways window by
window, by 128-bit hashes of the windows' words. Matches of neighbouring
windows and blocks join into maximal repeats.

Nothing is compared pair by pair: each window only needs the smallest document
that holds it, a minimum with map-side combine, so a passage shared by any
number of documents costs what it costs to read it there. Texts move twice:
to the occurrences that are extended, and to the spans that are cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import materialize, row_key
from shoplens.llm.winnow import gram_hashes, least_at, word_hashes

WINDOW = 50
#: Words of an anchor; one anchor in about (WINDOW - GRAM) / 2 words.
GRAM = 10


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, unchanged; null has none."""
    return (text or "").encode().split()


def _offsets(ws: list[bytes]) -> np.ndarray:
    """Start of each word in the words joined by a space, and one past it all."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)])


def blocks(ws: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(anchor, content, first window, windows) of each block, as arrays."""
    from xxhash import xxh3_64_intdigest
    if len(ws) < window:
        return (np.empty(0, np.int64),) * 4
    gram = min(gram, window)
    grams = gram_hashes(word_hashes(ws), gram)
    own = least_at(grams, window - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(own)]]))
    norm, off = b" ".join(ws), _offsets(ws)
    lo, hi = off[first].tolist(), (off[first + count + window - 1] - 1).tolist()
    content = np.fromiter((xxh3_64_intdigest(norm[i:j]) for i, j in zip(lo, hi)), np.uint64, len(lo))
    return grams[own[first]].view(np.int64), content.view(np.int64), first, count


def _windows(ws: list[bytes], first: list[int], count: list[int], window: int):
    """(window, 128-bit hash) of every window of the given runs."""
    from xxhash import xxh3_128_digest
    norm, off = b" ".join(ws), _offsets(ws).tolist()
    at = sorted({i for f, n in zip(first, count) for i in range(f, f + n)})
    return at, [xxh3_128_digest(norm[off[i]:off[i + window] - 1]) for i in at]


def merged(first: np.ndarray, past: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges [first, past)."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(past[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    lo = first[new]
    hi = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(reach) - 1]])]
    return list(zip(lo.tolist(), hi.tolist()))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, spans (maximal repeats: first
    word, one past the last), kept_text (the other words, joined by a space).

    A word is in a repeat if a window of ``window`` words covers it whose
    words also start in a row with a smaller id; windows are judged on the
    input. Rows that share an id, repeated rows too, are not repeats of each
    other but all are repeats of smaller ids, and cost what as many short texts
    cost; rows with a null id are kept
    whole and make no repeats. Null and empty texts have no words, texts
    shorter than a window no windows. Texts of any length are read whole; an
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(F.col(f"`{text_col}`")).alias("key"),
                       F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    kind = id_type.simpleString()

    def seed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = [blocks(words(t), window, gram) for t in b.column(2).to_pylist()]
            size = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
            at = pa.array(np.repeat(np.arange(len(found)), size))
            a, c, f, n = (np.concatenate([x[i] for x in found]) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(a), pa.array(c),
                 pa.array(f.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["doc_id", "key", "anchor", "content", "first", "count"])

    seeds = materialize(rows.where("doc_id is not null").mapInArrow(
        seed, f"doc_id {kind}, key long, anchor long, content long, first int, count int"), "anchors")
    shared = (seeds.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
              .where("x < y").select("anchor"))
    # written, so that both sides of the join are plain shuffles and a hot anchor's rows are split
    shared = materialize(shared, "shared-anchors")
    hits = materialize(seeds.join(shared, "anchor", "left_semi"), "anchor-hits")

    same = ["anchor", "content"]
    least = materialize(hits.groupBy(*same).agg(F.min("doc_id").alias("least")), "blocks")
    several = least.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("several"))
    least = materialize(least.join(several, "anchor", "left"), "blocks-of-several")
    judged = materialize(hits.join(least, same).where("doc_id > least or several")
                         .select("doc_id", "key", "first", "count", (F.col("doc_id") > F.col("least")).alias("match")),
                         "block-matches")

    # one occurrence of each block that has others beside it, window by window
    todo = (judged.where("not match").groupBy("doc_id", "key")
            .agg(F.collect_set(F.struct("first", "count")).alias("runs")))  # repeated rows give a run once

    def extend(batches):
        for b in batches:
            doc, at, digest = [], [], []
            for i, (text, runs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                w, d = _windows(words(text), [r["first"] for r in runs], [r["count"] for r in runs], window)
                doc.extend([i] * len(w)), at.extend(w), digest.extend(d)
            i = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(i), b.column(1).take(i), pa.array(at, pa.int32()), pa.array(digest, pa.binary())],
                names=["doc_id", "key", "first", "digest"])

    ends = (rows.join(todo, ["doc_id", "key"]).select("doc_id", "key", "text", "runs")
            .mapInArrow(extend, f"doc_id {kind}, key long, first int, digest binary"))
    ends = materialize(ends, "windows")
    twice = (ends.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("least < most").select("digest", "least"))
    ends = ends.join(twice, "digest").where("doc_id > least").select("doc_id", "key", "first", F.lit(1).alias("count"))

    runs = (judged.where("match").select("doc_id", "key", "first", "count").unionByName(ends)
            .groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "count")).alias("runs")))

    def cut(batches):
        for b in batches:
            spans, size, kept = [], [], []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ws = words(text)
                size.append(len(ws))
                if runs:
                    first = np.array([r["first"] for r in runs])
                    own = merged(first, first + np.array([r["count"] for r in runs]) + window - 1)
                else:
                    own = []
                spans.append([{"first": lo, "past": hi} for lo, hi in own])
                rest, at = [], 0
                for lo, hi in [*own, (len(ws), len(ws))]:
                    rest.extend(ws[at:lo])
                    at = hi
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "spans", "kept_text"])

    return (rows.join(runs, ["doc_id", "key"], "left").select("doc_id", "text", "runs")
            .mapInArrow(cut, f"doc_id {kind}, n_words long, spans array<struct<first:int,past:int>>, "
                             "kept_text string"))
