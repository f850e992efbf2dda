"""Exact de-duplication by content-defined chunk recipes, with built-in
functions only.

Each text, without its white space, is cut into chunks where its content says
so; a document becomes the ordered list of its chunk identifiers (its
recipe), and only these short lists are grouped and joined. Chunk contents
move once, to verify that an identifier stands for one content: identifiers
found with several contents get a rank per content, which becomes part of the
recipes that hold them. Equal recipes are therefore equal texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import keyed, materialize, row_key

#: What is deleted before texts are compared: [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Smallest and largest chunk, in characters.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: A chunk that is long enough ends behind the first pair of this kind.
CUT = r"(?<=[aeionu0-4][dlnrst5-9])"


def normalised(text: Column) -> Column:
    """The text without white space; null as empty."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def chunks(norm: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """Content-defined chunks in order; their concatenation is ``norm``."""
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{low},{high}}}?{CUT}|.{{1,{high}}}"), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                low: int = MIN_CHUNK, high: int = MAX_CHUNK, id_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, key (of the row's own text), keep_id,
    group_size, kept, text_sha256.

    Rows whose texts are equal without white space form a group; the row with
    the most code points stays, then the smallest id (a null id comes last),
    then any one of rows that agree in both. Null and empty texts, and texts
    of white space alone, are one group. Repeated rows count as rows of their
    own, and one of them stays. An empty table gives no rows. Other columns
    are not read. ``id_bits`` narrows the identifiers, for tests of the
    verification.
    """
    norm = normalised(F.col("text"))
    parts = keyed(docs, id_col, text_col).select(
        "uid", "doc_id", row_key(F.col("text")).alias("key"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("points"), norm.alias("norm"))
    parts = parts.withColumn("chunks", chunks(F.col("norm"), low, high))

    contents = (parts.select(F.explode("chunks").alias("chunk"))
                .select(_identifier(F.col("chunk"), id_bits).alias("h"), "chunk"))
    # every content moves once here; the identifiers found with several contents are few
    shared = materialize(contents.distinct().groupBy("h").count().where("count > 1").select("h"), "chunk-shared")
    ranks = materialize(contents.join(shared, "h", "left_semi").distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))), "chunk-ranks")

    recipes = materialize(parts.select(
        "uid", "doc_id", "key", "points", F.sha2("norm", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: _identifier(c, id_bits)).alias("recipe")), "recipes")

    # (position, rank) of chunks whose identifier needs the rank, by row content
    doubtful = parts.select(F.xxhash64("doc_id").alias("id_hash"), "key", F.posexplode("chunks").alias("pos", "chunk"))
    doubtful = (doubtful.withColumn("h", _identifier(F.col("chunk"), id_bits)).join(ranks, ["h", "chunk"])
                .groupBy("id_hash", "key").agg(F.array_sort(F.collect_set(F.struct("pos", "rank"))).alias("ranks")))
    recipes = (recipes.withColumn("id_hash", F.xxhash64("doc_id"))
               .join(doubtful, ["id_hash", "key"], "left").drop("id_hash"))
    empty = F.array().cast("array<struct<pos:int,rank:int>>")
    recipes = recipes.withColumn("ranks", F.coalesce("ranks", empty))

    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "uid"))
    groups = (recipes.groupBy("recipe", "ranks").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
              .select("recipe", "ranks", "group_size", F.col("best.doc_id").alias("keep_id"),
                      F.col("best.uid").alias("keep_uid")))
    return (recipes.join(groups, ["recipe", "ranks"])
            .select("doc_id", "key", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
                    "text_sha256"))
