"""SimHash near-de-duplication by multi-index hashing.

Equal fingerprints are one class from the start. The 64 bits of each distinct
fingerprint are cut into ``segments``; two fingerprints within ``max_bits``
agree in some segment up to max_bits // segments bits, so each fingerprint
looks up the small Hamming ball around each of its segments in the table of
exact segment values, and what it fetches is verified on all 64 bits.

Entries with few members are fetched and verified in one join. A family of
near copies fills single entries with members that are all linked to each
other; no pairs are written out for these: what such an entry holds and what
looks it up meet in tasks of bounded size (dealt in a grid of blocks, in which
every pair still meets once), the verification is a walk there that compares
what it has reached with what it has not, and it gives only links that join
parts not joined by its earlier links. Connectivity, and so the result, is the
same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import hex64, keyed, materialize, row_key
from shoplens.llm.components import components

#: Members of one table entry (or lookups of it) that one task takes at once.
BLOCK = 2048
#: Members up to which the lookups of a table entry are verified one by one.
CROWD = 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles of a text: words are runs without ASCII
    white space, A-Z in lower case; a bit is set if more than half of the
    shingle hashes (XXH64, seed 42, repeats included) have it. Fewer words
    than a shingle are one shingle; no words give 0."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = [0, *ends[:len(words) - k].tolist()]
    stops = (ends[k - 1:] - 1).tolist()
    hashes = np.array([xxh64_intdigest(norm[i:j], 42) for i, j in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, key, fp) per row, written once; fp is the fingerprint as
    a signed 64-bit value."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp, pa.int64())],
                                             names=["uid", "doc_id", "key", "fp"])

    rows = keyed(docs, id_col, text_col).select("uid", "doc_id", row_key(F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"uid long, doc_id {kind}, key long, fp long"), "fingerprints")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of the 64 bits."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(width: int, radius: int) -> list[int]:
    """What has to be flipped to reach each value of the Hamming ball."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def spanning(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Pairs within ``max_bits`` that connect the distinct ``fps`` (unsigned)
    as all such pairs would: a breadth-first walk in which each one found is
    compared only with those not reached yet."""
    if len(fps) < 12:
        left, out = fps.tolist(), []
        while left:
            front = [left.pop()]
            while front:
                x = front.pop()
                near = [y for y in left if (x ^ y).bit_count() <= max_bits]
                out.extend((x, y) for y in near)
                front.extend(near)
                left = [y for y in left if y not in near] if near else left
        return out
    left, out = fps, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = np.bitwise_count(now[:, None] ^ left[None, :]) <= max_bits
            hit = near.any(axis=0)
            if hit.any():
                out.extend(zip(now[near.argmax(axis=0)[hit]].tolist(), left[hit].tolist(), strict=True))
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return out


def _linked(batches, max_bits: int):
    """Links within each (entry, cell) run of rows sorted by it; a run may go
    on in the next batch."""
    def links(part: np.ndarray):
        if part["probe"].min() == 1:
            return []
        return spanning(np.unique(part["fp"]), max_bits)

    rest = None
    for b in _with_end(batches):
        out = []
        if b is not None:
            part = np.empty(b.num_rows, [("entry", "i8"), ("cell", "i8"), ("probe", "i1"), ("fp", "u8")])
            part["entry"], part["cell"] = b.column(0).to_numpy(), b.column(1).to_numpy()
            part["probe"], part["fp"] = b.column(2).to_numpy(), b.column(3).to_numpy().view(np.uint64)
            rest = part if rest is None else np.concatenate([rest, part])
        if rest is None or not len(rest):
            continue
        cut = np.flatnonzero((rest["entry"][1:] != rest["entry"][:-1]) | (rest["cell"][1:] != rest["cell"][:-1])) + 1
        edges = [0, *cut.tolist()] + ([len(rest)] if b is None else [])
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                out.extend(links(rest[lo:hi]))
        rest = rest[edges[-1]:]
        if out:
            pairs = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _with_end(batches):
    yield from batches
    yield None


def links(fps: DataFrame, max_bits: int = 4, segments: int = 3, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(a, b) such that distinct fingerprints of ``fps(fp)`` are connected by
    these pairs exactly as by all pairs within ``max_bits``; each pair given
    is within ``max_bits``."""
    radius = max_bits // segments
    cuts = _segments(segments)
    fp = F.col("fp")
    value = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in cuts]
    tag = [F.lit(i << 58) for i in range(segments)]
    entries = fps.select("fp", F.explode(F.array(*[t.bitwiseOR(v) for t, v in zip(tag, value)])).alias("entry"))

    def ball(tag, value, width):
        # a pair that differs in a segment is looked up from the smaller value only
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)])
        around = F.filter(F.transform(masks, lambda m: value.bitwiseXOR(m)), lambda x: x >= value)
        return F.transform(around, lambda x: tag.bitwiseOR(x))

    balls = [ball(t, v, w) for t, v, (_, w) in zip(tag, value, cuts)]
    lookups = fps.select("fp", F.explode(F.flatten(F.array(*balls))).alias("entry"))

    # entries with few members: the lookups that fetch them, verified in the join
    crowded = materialize(entries.groupBy("entry").agg(F.count("fp").alias("own")).where(F.col("own") > crowd),
                          "simhash-crowded")
    a, b = lookups.join(crowded, "entry", "left_anti").alias("a"), entries.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    found = (a.join(b, (F.col("a.entry") == F.col("b.entry")) & (F.col("a.fp") != F.col("b.fp")) & near)
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))

    # crowded entries: members and lookups are dealt in a grid of blocks
    rows = materialize(
        entries.withColumn("probe", F.lit(0).cast("tinyint"))
        .unionByName(lookups.withColumn("probe", F.lit(1).cast("tinyint")))
        .join(crowded.select("entry"), "entry"), "simhash-crowds")
    sizes = rows.groupBy("entry").agg(
        F.ceil(F.count_if(F.col("probe") == 0) / block).cast("int").alias("own_blocks"),
        F.ceil(F.count_if(F.col("probe") == 1) / block).cast("int").alias("look_blocks"))
    dealt = rows.join(sizes, "entry")
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("probe") == 0, F.col("own_blocks")).otherwise(F.col("look_blocks")))
    others = F.sequence(F.lit(0), F.when(F.col("probe") == 0, F.col("look_blocks")).otherwise(F.col("own_blocks")) - 1)
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(others))
    cell = F.when(F.col("probe") == 0, F.col("mine") * F.col("look_blocks") + F.col("other")).otherwise(
        F.col("other") * F.col("look_blocks") + F.col("mine"))
    dealt = dealt.select("entry", cell.cast("long").alias("cell"), "probe", "fp")
    walked = (dealt.repartition("entry", "cell").sortWithinPartitions("entry", "cell")
              .mapInArrow(lambda batches: _linked(batches, max_bits), "a long, b long"))
    return found.unionByName(walked)


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3,
                   id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: uid, doc_id, key (of the text), fingerprint (16
    hex digits), component_id (smallest id reachable over links of at most
    ``max_bits`` differing bits), kept (whether the row is the one of its
    component that stays: by smallest id, null ids last, then key, then uid).

    Texts without words -- null, empty, white space -- have fingerprint zero
    and link like any other. Repeated rows share a component. A null id is
    ignored for the smallest id unless the component has no other. Whole texts
    are read at any length; an empty table gives no rows. Other columns are
    not read.
    """
    rows = fingerprints(docs, shingle, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "uid")
    classes = materialize(rows.groupBy("fp").agg(F.min(order).alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits, segments, block))
    joined = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "simhash-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("first"))
    labels = joined.join(least, "root").select("fp", "first")
    return rows.join(labels, "fp").select("uid", "doc_id", "key", hex64(F.col("fp")).alias("fingerprint"),
                                          F.col("first.doc_id").alias("component_id"),
                                          (F.col("uid") == F.col("first.uid")).alias("kept"))
