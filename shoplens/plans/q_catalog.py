"""Registered queries: catalogue sources, cleaning, reviewers and sentiment
(SURVEY 2.1, 2.3, 2.4, 2.5, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.columns import camel_split, number_taker, split_pipe
from shoplens.operators import catalog as K
from shoplens.plans.registry import register
from shoplens.sources import files
from shoplens.sources.fixtures import catalog, sentiment

CAT_FLOATS = ["discounted_price", "actual_price", "discount_percentage", "rating", "rating_count"]


def rows(spark, sf):
    """Clean catalogue rows, one per (product, reviewer). The shared stage holds
    the rows before the reviewer lists are exploded, each text once."""
    from shoplens.plans.stages import shared
    return K.explode_reviewers(shared(spark, sf, "catalog_offers", lambda: K.clean_offers(catalog(spark, sf))))


def reviews(spark, sf):
    """``rows`` without the blurb, for entries that do not return it: distinct raw
    rows are told apart by its digest, so that texts are read but not moved."""
    from shoplens.plans.stages import shared
    return K.explode_reviewers(shared(spark, sf, "catalog_reviews", lambda: K.clean_offers(
        catalog(spark, sf, digest=True)).drop("about_product")))


def products(spark, sf):
    from shoplens.plans.stages import shared
    return shared(spark, sf, "catalog_products", lambda: K.product_table(rows(spark, sf)))


@register("src_catalog_csv", ["catalog_raw"], "select * from catalog_raw")
def q_src_catalog_csv(spark, sf):
    path = files.fresh_path(spark, "catalog-csv")
    files.write_csv(catalog(spark, sf), path)
    return files.read_catalog_csv(spark, path)


@register("src_sentiment_join_input", ["sentiment"], "select distinct * from sentiment",
          floats=["neg", "neu", "pos", "compound"])
def q_src_sentiment(spark, sf):
    path = files.fresh_path(spark, "sentiment-csv")
    files.write_csv(sentiment(spark, sf), path)
    return files.read_sentiment_csv(spark, path)


@register("numeric_processing", ["cat_num"], "select * from cat_num", floats=CAT_FLOATS)
def q_numeric_processing(spark, sf):
    return K.numeric_processing(catalog(spark, sf).dropDuplicates())


@register("number_taker", ["catalog_raw"], """
 select product_id, actual_price as raw, try_cast(nullif(array_to_string(regexp_extract_all(actual_price,
  '\\d+\\.\\d+|\\d+'), ''), '') as double) as value from catalog_raw""", floats=["value"])
def q_number_taker(spark, sf):
    return catalog(spark, sf).select("product_id", F.col("actual_price").alias("raw"),
                                     number_taker("actual_price").alias("value"))


@register("rating_missing", ["cat_num"], "select * from cat_num where rating is null", floats=CAT_FLOATS)
def q_rating_missing(spark, sf):
    return K.rating_missing(K.numeric_processing(catalog(spark, sf).dropDuplicates()))


@register("fill_rating", ["cat_typed"], "select product_id, rating from cat_typed", floats=["rating"])
def q_fill_rating(spark, sf):
    return K.fill_rating(K.numeric_processing(catalog(spark, sf).dropDuplicates())).select("product_id", "rating")


@register("split_category_pipe", ["cat_typed"], "select product_id, category_1, category_2 from cat_typed")
def q_split_category_pipe(spark, sf):
    return K.split_category(catalog(spark, sf).dropDuplicates()).select("product_id", "category_1", "category_2")


@register("fix_camel_case", ["catalog_raw"], """
 select product_id, regexp_replace(string_split(category, '|')[1], '([A-Z&])', ' \\1', 'g') as category_1
 from catalog_raw""")
def q_fix_camel_case(spark, sf):
    return catalog(spark, sf).select("product_id", camel_split(split_pipe("category", 0)).alias("category_1"))


@register("rating_category", ["cat_banded"], "select product_id, rating, rating_score from cat_banded",
          floats=["rating"])
def q_rating_category(spark, sf):
    df = K.rating_score(K.fill_rating(K.numeric_processing(catalog(spark, sf).dropDuplicates())))
    return K.drop_mismatched_reviewers(df).select("product_id", "rating", "rating_score")


@register("price_difference", ["cat_banded"], "select product_id, price_difference from cat_banded",
          floats=["price_difference"])
def q_price_difference(spark, sf):
    df = K.price_difference(K.numeric_processing(catalog(spark, sf).dropDuplicates()))
    return K.drop_mismatched_reviewers(df).select("product_id", "price_difference")


@register("strip_ids", ["catalog_raw"], "select trim(product_id) as product_id, trim(user_id) as user_id from catalog_raw")
def q_strip_ids(spark, sf):
    return K.strip_ids(catalog(spark, sf)).select("product_id", "user_id")


@register("mismatched_reviewers", ["catalog_raw"], """
 select * from catalog_raw where (length(user_id) - length(replace(user_id, ',', '')))
  - (length(user_name) - length(replace(user_name, ',', ''))) = -1""")
def q_mismatched_reviewers(spark, sf):
    return K.mismatched_reviewers(catalog(spark, sf))


@register("explode_reviewers", ["cat_rows"], "select product_id, user_id, user_name from cat_rows")
def q_explode_reviewers(spark, sf):
    return reviews(spark, sf).select("product_id", "user_id", "user_name")


@register("positional_zip", ["cat_banded"], """
 select product_id, unnest(string_split(user_id, ',')) as user_id, unnest(string_split(user_name, ',')) as user_name,
  unnest(range(len(string_split(user_id, ',')))) as pos from cat_banded""")
def q_positional_zip(spark, sf):
    df = K.drop_mismatched_reviewers(catalog(spark, sf).dropDuplicates())
    ids, names = F.split("user_id", ","), F.split("user_name", ",")
    n = F.greatest(F.size(ids), F.size(names))
    z = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(ids, i).alias("user_id"), F.get(names, i).alias("user_name"), i.cast("bigint").alias("pos")))
    return df.select("product_id", F.inline(z))


@register("distinct_product_names", ["cat_products"], "select * from cat_products", floats=CAT_FLOATS)
def q_distinct_product_names(spark, sf):
    return K.product_table(rows(spark, sf))


@register("user_review_counts", ["cat_rows"], """
 select user_id, count(*) as count from cat_rows group by user_id having count(*) <> 1""")
def q_user_review_counts(spark, sf):
    return K.user_review_counts(reviews(spark, sf))


@register("active_users", ["cat_rows"], """
 select product_id, user_id, user_name, rating from cat_rows
 where user_id in (select user_id from cat_rows group by user_id having count(*) >= 10)""", floats=["rating"])
def q_active_users(spark, sf):
    return K.active_users(reviews(spark, sf)).select("product_id", "user_id", "user_name", "rating")


@register("join_sentiment", ["cat_final"], "select * from cat_final",
          floats=CAT_FLOATS + ["price_difference", "neg", "neu", "pos", "compound"])
def q_join_sentiment(spark, sf):
    return K.join_sentiment(rows(spark, sf), sentiment(spark, sf)).select(*K.FINAL_COLUMNS)


@register("ids_not_in", ["cat_rows", "sentiment"], """
 select distinct product_id from sentiment where product_id not in (select product_id from cat_rows)""")
def q_ids_not_in(spark, sf):
    return K.ids_not_in(reviews(spark, sf), sentiment(spark, sf))


@register("product_url", ["cat_products"], """
 select concat('https://shop.example.com/dp/', product_id) as urls, product_id from
 (select distinct product_id, product_name from cat_rows)""")
def q_product_url(spark, sf):
    return K.product_url(reviews(spark, sf).select("product_id", "product_name").distinct())


@register("select_into", ["cat_rows"], "select distinct product_id, product_name from cat_rows")
def q_select_into(spark, sf):
    return reviews(spark, sf).select("product_id", "product_name").distinct()


@register("product_content", ["cat_products", "sentiment"], """
 select * from cat_products where product_id in (select product_id from sentiment where compound > 0.5)""",
          floats=CAT_FLOATS)
def q_product_content(spark, sf):
    ids = sentiment(spark, sf).filter(F.col("compound") > 0.5).select("product_id")
    return products(spark, sf).join(ids, "product_id", "left_semi")


@register("result_card", ["cat_products"], """
 select product_id, case when length(product_name) > 300 then substr(product_name, 1, 300) || '...'
   else product_name end as title, discounted_price, actual_price,
  repeat('★', least(greatest(cast(floor(rating) as integer), 0), 5))
   || repeat('☆', 5 - least(greatest(cast(floor(rating) as integer), 0), 5)) as stars,
  rating, rating_count, img_link, product_link from cat_products""",
          floats=["discounted_price", "actual_price", "rating", "rating_count"])
def q_result_card(spark, sf):
    return K.result_card(products(spark, sf))
