"""Views in the reference's input shapes, derived by Spark from the given
tables (see FIXTURES.md): ``shop`` raw events, ``catalog`` raw catalogue,
search queries and sentiment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.sources.schemas import SEARCH_QUERY
from shoplens.sources.tables import load_table


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw shop events (M1) from ``events`` joined to ``part``.

    Every event with event_id % 50 = 0 is repeated exactly once, so the
    de-duplication operators have real work. The join to ``part`` is left to
    Catalyst/AQE: broadcast when the measured part side is small, otherwise a
    shuffle join on the product key.
    """
    ev = load_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    ev = ev.unionByName(ev.filter(F.col("event_id") % 50 == 0))
    part = load_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    j = ev.join(part, k == F.col("p_partkey"), "inner")
    etype = (F.when(F.col("event_type") == "click", "cart")
             .when(F.col("event_type") == "error", "remove_from_cart")
             .when(F.col("event_type") == "signup", "view")
             .otherwise(F.col("event_type")))
    code = (F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string"))
            .when(F.col("p_size") % 7 == 0, F.lower("p_type"))
            .otherwise(F.concat(F.lower("p_type"), F.lit("."),
                                F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))))
    brand = (F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
             .when((F.col("p_partkey") % 10 == 0) & (F.col("event_id") % 3 == 0),
                   F.concat("p_brand", F.lit("-alt")))
             .otherwise(F.col("p_brand")))
    price = (F.when(F.col("event_id") % 97 == 0, F.lit(0.0))
             .when(F.col("event_id") % 211 == 0, F.lit(-1.0))
             .otherwise(F.col("value")))
    return j.select(
        F.col("ts").alias("event_time"),
        etype.alias("event_type"),
        F.col("p_partkey").alias("product_id"),
        F.col("p_size").cast("bigint").alias("category_id"),
        code.alias("category_code"),
        brand.alias("brand"),
        price.alias("price"),
        F.col("user_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.to_date("ts").cast("string")).alias("user_session"),
    )


def catalog(spark: SparkSession, sf_dir: str, digest: bool = False) -> DataFrame:
    """Raw catalogue rows (M8) from ``part`` joined to ``documents``
    (doc_id = p_partkey); the whole document text is the product blurb, null
    for parts without one. Names carry the part key, but each five parts
    whose keys end in 00, 20, 40, 60, 80 share one name.

    The join runs on the product id and the key is compared beside it (ids of
    ten digits and more are cut), so the texts lie by a column of the result
    and its distinct rows are found without moving them again. The texts are
    never broadcast: files look smaller than the hash table that the driver
    would build of them.

    ``digest``: the SHA-256 of the blurb stands for it, for consumers that only
    have to tell blurbs apart; then no text is moved."""
    s = lambda c: c.cast("string")
    pid = lambda c: F.concat(F.lit("B"), F.lpad(s(F.col(c)), 9, "0"))
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                                 pid("p_partkey").alias("product_id"))
    text = F.sha2("text", 256).alias("text") if digest else F.col("text")
    d = load_table(spark, sf_dir, "documents").select("doc_id", text, pid("doc_id").alias("_pid"))
    k = F.col("p_partkey")
    j = p.join(d.hint("merge"), (F.col("product_id") == F.col("_pid")) & F.col("doc_id").between(k, k), "left")
    lp3 = lambda c: F.lpad(s(c), 3, "0")
    cat1 = (F.when(F.col("p_size") % 3 == 0, "Computers&Accessories")
            .when(F.col("p_size") % 3 == 1, "Electronics").otherwise("HomeKitchen"))
    rating = (F.when(k % 31 == 0, "|").when(k % 29 == 0, "5.0")
              .otherwise(F.concat(s(k % 4 + 1), F.lit("."), s(k % 10))))
    rating_count = F.when(k % 43 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(s(F.col("p_size")), F.lit(","), lp3((k * 7) % 1000)))
    uid = F.when(k % 3 == 0, F.concat(F.lit("U"), s(k % 50))).otherwise(
        F.concat(F.lit("U"), s(k % 50), F.lit(",U"), s((k * 3) % 50)))
    uname = (F.when((k % 3 == 0) & (k % 5 == 0), F.concat(F.lit("N"), s(k % 50), F.lit(",Jr")))
             .when(k % 3 == 0, F.concat(F.lit("N"), s(k % 50)))
             .otherwise(F.concat(F.lit("N"), s(k % 50), F.lit(",N"), s((k * 3) % 50))))
    return j.select(
        "product_id",
        F.when(k % 20 == 0, F.concat(F.lit("bundle "), s(k - k % 100)))
        .otherwise(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), s(k))).alias("product_name"),
        F.col("text").alias("about_product"),
        F.concat(cat1, F.lit("|"), F.replace(F.col("p_type"), F.lit(" "), F.lit("")),
                 F.lit("|"), F.col("p_name")).alias("category"),
        F.concat(F.lit("₹"), s(k % 9 + 1), F.lit(","), lp3((k * 37) % 1000)).alias("discounted_price"),
        F.concat(F.lit("₹"), s(k % 9 + 2), F.lit(","), lp3((k * 53) % 1000), F.lit(".50")).alias("actual_price"),
        F.concat(s(F.col("p_size")), F.lit("%")).alias("discount_percentage"),
        rating.alias("rating"),
        rating_count.alias("rating_count"),
        uid.alias("user_id"),
        uname.alias("user_name"),
        F.concat(F.lit("http://img.example.com/"), s(k)).alias("img_link"),
        F.concat(F.lit("http://shop.example.com/dp/"), s(k)).alias("product_link"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-computed sentiment rows keyed by catalogue product_id; the scores
    are arithmetic on the part key (no scorer exists in the reference)."""
    p = load_table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    neg = (k % 7).cast("double") / 20.0
    neu = (k % 11).cast("double") / 20.0
    pos = F.lit(1.0) - neg - neu
    return p.select(
        F.concat(F.lit("B"), F.lpad(k.cast("string"), 9, "0")).alias("product_id"),
        neg.alias("neg"), neu.alias("neu"), pos.alias("pos"), (pos - neg).alias("compound"))


# The literal search queries of the fixtures (3 is misspelt).
SEARCH_QUERIES = [(1, "the worthless"), (2, "tha ering"), (3, "wrthless"), (4, "zzzz")]


def search_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCH_QUERIES, SEARCH_QUERY)


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per part: its lower-cased name and the first longer word of its
    blurb. The word is taken before the join, so that no text is moved, and the
    join is never broadcast."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    word = F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0)
    d = load_table(spark, sf_dir, "documents").select("doc_id", word.alias("word"))
    return (p.join(d.hint("merge"), F.col("doc_id") == F.col("p_partkey"), "left")
            .select(F.col("p_partkey").alias("query_id"),
                    F.concat_ws(" ", F.lower("p_name"), F.nullif("word", F.lit(""))).alias("text")))
