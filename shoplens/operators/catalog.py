"""Catalogue cleaning (M8 -> M9): dirty money / rating strings to numbers,
category path split, rating bands, reviewer lists exploded in step, and the
sentiment join. One select chain, one explode, one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.functions.columns import (camel_split, count_char, number_taker, rating_category,
                                        split_pipe, star_bar, truncate_text)

FINAL_COLUMNS = ["product_id", "product_name", "about_product", "category_1", "category_2",
                 "discounted_price", "actual_price", "discount_percentage", "price_difference",
                 "rating", "rating_count", "rating_score", "neg", "neu", "pos", "compound",
                 "user_id", "user_name", "img_link", "product_link"]
PRODUCT_COLUMNS = ["product_id", "product_name", "about_product", "category_1", "category_2",
                   "discounted_price", "actual_price", "discount_percentage", "rating",
                   "rating_count", "img_link", "product_link"]
# Rating used when the raw rating does not parse; reviewers
# needed to feed the recommender.
DEFAULT_RATING = 4.0
RATING_THRESHOLD = 10


def numeric_processing(df: DataFrame) -> DataFrame:
    """Parse the five measure strings; the discount becomes a fraction."""
    return df.withColumns({
        "discounted_price": number_taker("discounted_price"),
        "actual_price": number_taker("actual_price"),
        "discount_percentage": number_taker("discount_percentage") / F.lit(100.0),
        "rating": number_taker("rating"),
        "rating_count": number_taker("rating_count"),
    })


def rating_missing(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rating").isNull())


def fill_rating(df: DataFrame, value: float = DEFAULT_RATING) -> DataFrame:
    return df.withColumn("rating", F.coalesce(F.col("rating"), F.lit(float(value))))


def split_category(df: DataFrame) -> DataFrame:
    """``A|B|C`` -> category_1, category_2 with camel-case words spaced."""
    cols = [c for c in df.columns if c != "category"]
    return df.select(*cols, camel_split(split_pipe("category", 0)).alias("category_1"),
                     camel_split(split_pipe("category", 1)).alias("category_2"))


def rating_score(df: DataFrame) -> DataFrame:
    return df.withColumn("rating_score", rating_category("rating"))


def price_difference(df: DataFrame) -> DataFrame:
    return df.withColumn("price_difference", F.col("actual_price") - F.col("discounted_price"))


def strip_ids(df: DataFrame, cols=("product_id", "user_id")) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c in cols})


def mismatched_reviewers(df: DataFrame) -> DataFrame:
    """Rows whose user_name list has one comma more than user_id."""
    return df.filter(count_char("user_id", ",") - count_char("user_name", ",") == -1)


def drop_mismatched_reviewers(df: DataFrame) -> DataFrame:
    d = count_char("user_id", ",") - count_char("user_name", ",")
    return df.filter(F.coalesce(d != -1, F.lit(True)))


def explode_reviewers(df: DataFrame) -> DataFrame:
    """Split the comma lists of reviewer ids and names and explode them in
    step (position i with position i, the shorter list padded with null)."""
    ids = F.split(F.col("user_id"), ",")
    names = F.split(F.col("user_name"), ",")
    n = F.greatest(F.size(ids), F.size(names))
    pairs = F.transform(F.sequence(F.lit(0), n - 1),
                        lambda i: F.struct(F.get(ids, i).alias("user_id"), F.get(names, i).alias("user_name")))
    rest = [c for c in df.columns if c not in ("user_id", "user_name")]
    out = df.select(*rest, F.inline(pairs))
    return out.select(*df.columns)


def clean_offers(raw: DataFrame) -> DataFrame:
    """Raw catalogue -> typed, split, banded, reviewer lists still whole."""
    df = raw.dropDuplicates()
    df = fill_rating(numeric_processing(df))
    df = price_difference(rating_score(split_category(df)))
    return drop_mismatched_reviewers(df)


def clean_catalog_rows(raw: DataFrame) -> DataFrame:
    """Raw catalogue -> typed, split, banded, one row per (product, reviewer)."""
    return explode_reviewers(clean_offers(raw))


def product_table(rows: DataFrame) -> DataFrame:
    """Product columns, first row per product_name (product_id breaks ties;
    a struct min per name, to which repeated rows make no difference)."""
    rest = [c for c in PRODUCT_COLUMNS if c != "product_name"]
    g = rows.groupBy("product_name").agg(F.min(F.struct(*rest)).alias("_r"))
    return g.select(*[F.col("product_name") if c == "product_name" else F.col("_r." + c).alias(c)
                      for c in PRODUCT_COLUMNS])


def first_ids(rows: DataFrame) -> DataFrame:
    """(product_name, product_id): the id of the row that ``product_table`` takes for each name."""
    g = rows.groupBy("product_name").agg(F.min(F.struct("product_id")).alias("_r"))  # a null id is the least
    return g.select("product_name", "_r.product_id")


def of_first_ids(raw: DataFrame, first: DataFrame) -> DataFrame:
    """The raw rows whose name and id are in ``first``, without those that have no
    id. The join runs on the id and the name is compared beside it, so that rows
    that lie by product id stay where they are."""
    f = first.select(F.struct("product_name").alias("_name"), F.col("product_id").alias("_id"))
    name = F.struct("product_name").between(F.col("_name"), F.col("_name"))  # no name is a name, too
    return raw.join(f.hint("merge"), (F.col("product_id") == F.col("_id")) & name, "left_semi")


def first_products(rows: DataFrame) -> DataFrame:
    """``product_table`` of rows ``of_first_ids``: rows that lie by product id stay where they are."""
    rest = [c for c in PRODUCT_COLUMNS if c not in ("product_name", "product_id")]
    g = rows.groupBy("product_id", "product_name").agg(F.min(F.struct(*rest)).alias("_r"))
    return g.select(*[c if c in ("product_name", "product_id") else F.col("_r." + c).alias(c) for c in PRODUCT_COLUMNS])


def user_review_counts(rows: DataFrame) -> DataFrame:
    """Rows per reviewer, those different from 1."""
    return (rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("count"))
            .filter(F.col("count") != 1))


def active_users(rows: DataFrame, threshold: int = RATING_THRESHOLD) -> DataFrame:
    """Rows of reviewers with at least ``threshold`` ratings."""
    act = (rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") >= threshold).select("user_id"))
    return rows.join(act, "user_id", "left_semi")


def join_sentiment(rows: DataFrame, sentiment: DataFrame) -> DataFrame:
    s = sentiment.select("product_id", "neg", "neu", "pos", "compound").distinct()
    return rows.join(s, "product_id", "left")


def ids_not_in(a: DataFrame, b: DataFrame, key: str = "product_id") -> DataFrame:
    """Distinct ids of ``b`` that are absent from ``a``."""
    return b.select(key).distinct().join(a.select(key), key, "left_anti")


def clean_catalog(raw: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The full M8 -> M9 chain in the final column order."""
    return join_sentiment(clean_catalog_rows(raw), sentiment).select(*FINAL_COLUMNS)


def product_url(df: DataFrame, base: str = "https://shop.example.com/dp/") -> DataFrame:
    return df.select(F.concat(F.lit(base), F.col("product_id")).alias("urls"), "product_id")


def result_card(products: DataFrame) -> DataFrame:
    """The fields a search result card shows."""
    return products.select(
        "product_id", truncate_text("product_name", 300).alias("title"),
        "discounted_price", "actual_price", star_bar("rating").alias("stars"),
        "rating", "rating_count", "img_link", "product_link")
