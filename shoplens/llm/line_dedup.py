"""Fuzzy line de-duplication by MinHash, with built-in functions only.

The shingles of a line are the ``SHINGLE`` characters from each word start, and
from each character of words that are longer than a shingle or hold a letter of
a script without spaces, so that each character is in a shingle. Equal lines are one
class from the start; each distinct line gets ``BANDS`` x ``ROWS`` minimum
hashes of 16 bits, lines that agree in a band are candidates, candidates whose
minimum hashes agree too seldom are left out, and the others are linked if the
exact Jaccard similarity of their shingle sets reaches the threshold. One line
of each connected component is kept.

Candidates of a bucket are first compared with its smallest member alone, and
joined; only members that are in different components after that are compared
with each other. So families of near copies do not give all their pairs, and
every two lines that share a bucket are either compared, already joined, or
left out for agreeing on fewer than 11 of the 24 minima (four standard
deviations below what a pair at the threshold agrees on) or for the sizes of
their sets. The join of members compares them itself, in the first band that
they share, and gives similar pairs alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import keyed, materialize
from shoplens.llm.components import components

SHINGLE = 12
SIMILARITY = 0.8
#: Recall of a pair at the threshold: 1 - (1 - 0.8^3)^8 = 0.997.
BANDS, ROWS = 8, 3
#: Slots of the broadcast that keeps the lines of other nodes from moving: its
#: bound, in rows.
SLOTS = 1 << 20


#: Scripts that are written without spaces between words.
UNSPACED = "".join(rf"\p{{Is{s}}}" for s in (
    "Han", "Hiragana", "Katakana", "Bopomofo", "Yi", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Tai_Le",
    "New_Tai_Lue", "Tai_Tham", "Tai_Viet", "Balinese", "Javanese"))
#: Printing characters before the first script of UNSPACED (Thai, from U+0E01).
PLAIN = r"!-\u0DFF"


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """The ``size`` characters from each start, in order: a word of at most
    ``size`` characters starts one, and each character of a longer word, or
    of one with a letter of ``UNSPACED``, starts one."""
    # scripts are looked up only for words with a character beyond PLAIN
    starts = (rf"(?s)(?=(\S.{{0,{size - 1}}}))(?:(?<!\S)(?:[{PLAIN}]{{1,{size}}}+(?!\S)"
              rf"|(?=[{PLAIN}]{{0,{size - 1}}}+[^\s{PLAIN}])[^\s{UNSPACED}]{{1,{size}}}+(?!\S))|\S)")
    return F.regexp_extract_all(line, F.lit(starts), F.lit(1))


def _line_id(line: Column) -> dict[str, Column]:
    """128 bits that stand for the content of a line: two seeds of one hash."""
    return {"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(7), line)}


def _minima(count: int) -> list[Column]:
    """Minimum hashes of the 64-bit shingle hashes ``s`` of a group: the
    smallest of a 16-bit part of the hash under exclusive or with a constant,
    which orders the parts anew for each constant."""
    parts = [F.shiftright(F.shiftleft(F.col("s"), 16 * i), 48) for i in range(4)]
    constants = [(i // 4 * 40503 + 9973 * (i % 4) + 1) * 25173 % 65536 - 32768 for i in range(count)]
    return [F.min(parts[i % 4].bitwiseXOR(F.lit(c).cast("long")).cast("short")).alias(f"m{i}")
            for i, c in enumerate(constants)]


def _packed(count: int) -> list[Column]:
    """The minima m0, m1, ... in words of four: w0, w1, ..."""
    def word(k):
        lanes = [F.shiftleft(F.col(f"m{i}").cast("long").bitwiseAND(F.lit(65535)), 16 * (i % 4))
                 for i in range(4 * k, 4 * k + 4)]
        out = lanes[0]
        for lane in lanes[1:]:
            out = out.bitwiseOR(lane)
        return out
    return [word(k).alias(f"w{k}") for k in range(count // 4)]


def _lane(word: Column, t: int) -> Column:
    return F.shiftright(word, 16 * t).bitwiseAND(F.lit(65535))


def _lanes(value: int) -> Column:
    """A word with ``value`` (below 2^15) in each lane."""
    return F.lit(sum(value << 16 * t for t in range(4))).cast("long")


def _differing(left: str, right: str, k: int) -> Column:
    return F.col(f"{left}.w{k}").bitwiseXOR(F.col(f"{right}.w{k}"))


def _agreeing(left: str, right: str, count: int) -> Column:
    """Minima on which two rows of words agree. A sum carries into bit 14 of
    each lane whose upper 14 or lower 2 bits differ."""
    out = F.lit(count)
    full = _lanes(0x3FFF)
    for k in range(count // 4):
        x = _differing(left, right, k)
        upper = F.shiftrightunsigned(x, 2).bitwiseAND(full) + full
        lower = x.bitwiseAND(_lanes(3)) + full
        out = out - F.bit_count(upper.bitwiseOR(lower).bitwiseAND(_lanes(0x4000)))
    return out


def _met_before(left: str, right: str, bands: int, rows: int) -> Column:
    """Whether two rows of words agree in a band before ``band`` of the left."""
    out = F.lit(False)
    for b in range(bands - 1):
        lanes = range(b * rows, (b + 1) * rows)
        same = F.col(f"{left}.band") > b
        for k in sorted({i // 4 for i in lanes}):
            own = [i % 4 for i in lanes if i // 4 == k]
            x = _differing(left, right, k)
            # lanes own[0] to own[-1], without the ones above and below
            x = F.shiftrightunsigned(F.shiftleft(x, 16 * (3 - own[-1])), 16 * (3 - own[-1] + own[0]))
            same = same & (x == 0)
        out = out | same
    return out


def _similar(left: str, right: str, count: int, similarity: float) -> Column:
    """Whether two rows of words and sets are similar; the cheap tests come
    first, and the bounds leave room for rounding."""
    x, y = F.col(f"{left}.set"), F.col(f"{right}.set")
    # four standard deviations below the agreement of a pair at the threshold
    seldom = math.floor(count * similarity - 4 * math.sqrt(count * similarity * (1 - similarity)))
    both = F.size(x) + F.size(y)
    return ((_agreeing(left, right, count) >= seldom)
            & (F.least(F.size(x), F.size(y)) * (1 + similarity) >= similarity * both - 1e-9)
            & (F.size(F.array_intersect(x, y)) * (1 + similarity) >= similarity * both - 1e-9))


def _links(members: DataFrame, bands: int, rows: int, similarity: float) -> DataFrame:
    """Similar pairs (a, b) of members of a bucket in different components,
    each once: from the first band in which both agree."""
    l, r = members.alias("l"), members.alias("r")
    pairs = l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.root") < F.col("r.root"))
                   & ~_met_before("l", "r", bands, rows) & _similar("l", "r", bands * rows, similarity))
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS,
               rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every text: uid (of the row), doc_id, line_no (from
    0), keep_id and keep_line (where the line that stays is), group_size
    (lines of the component), kept.

    Lines are what ``\\n`` separates. The first line of a component in the
    order of document id (null last), row and line number stays. Lines without
    a word are no copies of each other: each is kept as a group of its own.
    Null texts have no lines, an empty text has one blank line. Repeated rows
    and rows that share an id are told apart by ``uid``. Texts and lines of
    any length are read whole; an empty table gives no rows. Other columns are
    not read.
    """
    lines = (keyed(docs, id_col, text_col)
             .select("uid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .withColumns(_line_id(F.col("line"))))
    places = materialize(lines.select("uid", "doc_id", "line_no", "h1", "h2",
                                      (~F.col("line").rlike(r"\S")).alias("blank")), "lines")

    # one hash table per task takes the minima: a row of it per distinct line
    count = bands * rows
    if count % 4:
        raise ValueError("bands x rows has to be a multiple of 4")
    words = [f"w{k}" for k in range(count // 4)]
    spread = lines.select("h1", "h2", F.explode(shingles(F.col("line"), size)).alias("s")).withColumn(
        "s", F.xxhash64("s"))
    nodes = materialize(spread.groupBy("h1", "h2").agg(*_minima(count)).select(
        F.monotonically_increasing_id().alias("node"), "h1", "h2", *_packed(count)), "line-signatures")

    keys = [F.xxhash64(F.lit(b), *[_lane(F.col(f"w{i // 4}"), i % 4) for i in range(b * rows, (b + 1) * rows)])
            for b in range(bands)]
    # the aggregate and the join read one exchange
    members = nodes.select("node", F.posexplode(F.array(*keys)).alias("band", "bucket")).repartition("bucket")
    buckets = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("node").alias("n")).where("n > 1")
    members = materialize(members.join(buckets, "bucket").select("bucket", "band", "node", "hub"), "line-buckets")

    # minima and shingle sets of the lines in buckets; lines in none of their slots do not move
    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "h1", "h2", *words), "node"),
                         "line-candidates")
    slot = F.col("h1").bitwiseAND(F.lit(SLOTS - 1))
    slots = F.broadcast(wanted.select(slot.alias("slot")).distinct())
    sets = materialize(
        lines.select("h1", "h2", "line", slot.alias("slot")).join(slots, "slot", "left_semi")
        .dropDuplicates(["h1", "h2"]).join(wanted, ["h1", "h2"])
        .select("node", *words, F.array_distinct(F.transform(
            shingles(F.col("line"), size), lambda s: F.xxhash64(s))).alias("set")), "line-sets")

    first = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = (first.alias("p").join(sets.alias("l"), F.col("p.a") == F.col("l.node"))
             .join(sets.alias("r"), F.col("p.b") == F.col("r.node")))
    edges = materialize(first.where(_similar("l", "r", count, similarity)).select("a", "b"), "line-links")
    roots = components(edges)
    named = members.join(roots, "node", "left").select(
        "bucket", "band", "node", "hub", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    # both sides of the join read one exchange
    named = (named.where("node <> hub").join(mixed.select("bucket"), "bucket", "left_semi")
             .join(sets, "node").repartition("bucket"))
    edges = materialize(edges.unionByName(_links(named, bands, rows, similarity)), "line-links")

    # a line that is linked to none is a group by its own content; linked lines are few beside all
    named = wanted.select("node", "h1", "h2")
    label = (components(edges).join(named, "node")
             .join(named.select(F.col("node").alias("root"), F.col("h1").alias("g1"), F.col("h2").alias("g2")), "root")
             .select("h1", "h2", "g1", "g2"))
    own = materialize(places.where("not blank").join(label, ["h1", "h2"], "left").select(
        "uid", "doc_id", "line_no", F.coalesce("g1", "h1").alias("g1"), F.coalesce("g2", "h2").alias("g2")), "line-groups")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid", "line_no")
    groups = own.groupBy("g1", "g2").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    judged = own.join(groups, ["g1", "g2"]).select(
        "uid", "doc_id", "line_no", F.col("keep.doc_id").alias("keep_id"), F.col("keep.line_no").alias("keep_line"),
        "group_size", ((F.col("uid") == F.col("keep.uid")) & (F.col("line_no") == F.col("keep.line_no"))).alias("kept"))
    blank = places.where("blank").select(
        "uid", "doc_id", "line_no", F.col("doc_id").alias("keep_id"), F.col("line_no").alias("keep_line"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return judged.unionByName(blank)
