"""Benchmark decontamination by winnowing.

A benchmark window is ``window`` consecutive words of an item (all words of a
shorter item). Every window keeps one fingerprint, the smallest hash of its
k-grams, on both sides; a window that occurs in a document has the same
fingerprint there, so joining the fingerprints finds every shared span of at
least a window. Hits are extended to the whole windows that own the
fingerprint, whose contents are compared by a 128-bit hash.

Texts are read once and never shuffled: a bitmap of fixed size, made from the
benchmark's fingerprints, leaves the few document windows that can match, and
only their hashes are joined.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import keyed, materialize, row_key
from shoplens.llm.winnow import gram_hashes, least_at, word_hashes

WINDOW = 10
#: Words of a fingerprinted k-gram.
GRAM = 5
#: Bits of the fingerprint bitmap (1 MB): the bound of what is broadcast.
BITMAP = 1 << 23
#: Words: runs of ASCII letters and digits and of all other than ASCII.
_WORDS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; null has none."""
    return (text or "").encode().translate(_WORDS).split()


class Windows(NamedTuple):
    """Windows of a text: first word, fingerprint, content hash."""
    start: np.ndarray
    fingerprint: np.ndarray
    content: list[bytes]


def own_grams(h: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each window of ``size`` words."""
    k = min(GRAM, size)
    grams = gram_hashes(h, k)
    return grams[least_at(grams, size - k + 1)]


def find_windows(ws: list[bytes], size: int, wanted: np.ndarray | None = None) -> Windows:
    """Windows of ``size`` words; with ``wanted``, a bitmap of fingerprints,
    only those whose fingerprint is in it."""
    from xxhash import xxh3_128_digest
    if len(ws) < size:
        return Windows(np.empty(0, np.int64), np.empty(0, np.uint64), [])
    fp = own_grams(word_hashes(ws), size)
    start = np.arange(len(fp))
    if wanted is not None:
        slot = fp & np.uint64(BITMAP - 1)
        start = np.flatnonzero(wanted[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
    content = [xxh3_128_digest(b" ".join(ws[i:i + size])) for i in start.tolist()]
    return Windows(start, fp[start], content)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """(item_id, size, fingerprint, content) of the distinct windows of each
    item, written once. Items without words have none."""
    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                size = min(window, len(ws))
                if size:
                    found = find_windows(ws, size)
                    out.extend((item, size, f, c) for f, c in
                               zip(found.fingerprint.view(np.int64).tolist(), found.content, strict=True))
            item, size, fp, content = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()),
                 pa.array(content, pa.binary())], names=["item_id", "size", "fingerprint", "content"])

    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"),
                             F.col(f"`{text_col}`").alias("text"))
    return materialize(items.mapInArrow(run, "item_id string, size int, fingerprint long, content binary").distinct(),
                       "benchmark-windows")


def _bitmaps(windows: DataFrame) -> dict[int, np.ndarray]:
    """Window size -> bitmap of its fingerprints; sizes are at most the
    window, and each bitmap is of the one fixed size."""
    slot = F.col("fingerprint").bitwiseAND(F.lit(BITMAP - 1))
    cells = (windows.groupBy("size", F.shiftright(slot, 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(fingerprint & 63))")).alias("bits")).toArrow())
    size, word, bits = (cells.column(i).to_numpy() for i in range(3))
    out = {}
    for n in np.unique(size).tolist():
        out[n] = np.zeros(BITMAP // 64, np.uint64)
        out[n][word[size == n]] = bits[size == n].view(np.uint64)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: uid, doc_id, key (of the text), n_words, n_hit
    (words inside any occurrence of a window), items (sorted ids, as strings,
    of the benchmark items with an occurring window), spans (the maximal hit
    runs of words: first, past).

    Null and empty texts have no words. Repeated rows, and rows that share an
    id, are judged on their own. An empty benchmark hits nothing; an empty
    table gives no rows. Items without words have no window; items that repeat
    a text all count. Other columns are not read. Null item ids are ignored in
    ``items``; their windows count as hits.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, window)
    wanted = spark.sparkContext.broadcast(_bitmaps(windows))

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for uid, doc, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ws = words(text)
                rows = [(uid, doc, key, len(ws), None, None, None, None)]
                for size, bits in wanted.value.items():
                    found = find_windows(ws, size, bits)
                    rows.extend((uid, None, None, None, s, size, f, c) for s, f, c in zip(
                        found.start.tolist(), found.fingerprint.view(np.int64).tolist(), found.content, strict=True))
                for r in rows:
                    for column, v in zip(out, r, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [pa.int64(), b.schema.field(1).type, pa.int64(), pa.int64(),
                                                      pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)],
                names=["uid", "doc_id", "key", "n_words", "at", "size", "fingerprint", "content"])

    rows = keyed(docs, id_col, text_col).select("uid", "doc_id", row_key(F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = materialize(rows.mapInArrow(run, f"uid long, doc_id {kind}, key long, n_words long, at int, size int, "
                                             "fingerprint long, content binary"), "document-windows")

    same = ["fingerprint", "size", "content"]
    places = found.where("at is not null").select("uid", "at", *same)
    hits = places.join(windows.select(*same).distinct(), same, "left_semi")
    # a document's own hits and items: as many as it has words, or the benchmark items
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "size"))),
        F.array().cast("array<struct<first:int,past:int>>"),
        lambda runs, w: F.when(
            (F.size(runs) > 0) & (F.element_at(runs, -1)["past"] >= w["at"]),
            F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
                F.element_at(runs, -1)["first"].alias("first"),
                F.greatest(F.element_at(runs, -1)["past"], w["at"] + w["size"]).alias("past")))))
        .otherwise(F.concat(runs, F.array(F.struct(w["at"].alias("first"), (w["at"] + w["size"]).alias("past"))))))
    spans = hits.groupBy("uid").agg(merged.alias("spans"))
    items = (places.select("uid", *same).distinct().join(windows, same).select("uid", "item_id").distinct()
             .groupBy("uid").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["past"] - s["first"]).cast("long"))
    return (found.where("at is null").select("uid", "doc_id", "key", "n_words")
            .join(spans, "uid", "left").join(items, "uid", "left")
            .select("uid", "doc_id", "key", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<first:int,past:int>>")).alias("spans")))
