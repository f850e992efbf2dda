"""Registered queries: sources, projection / filters, de-duplication and the
cleaning chain (SURVEY 2.1-2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import clean as C
from shoplens.plans.registry import register
from shoplens.sources.fixtures import shop


def clean(spark, sf):
    """Clean events (M2) as a shared stage table."""
    from shoplens.plans.stages import shared
    return shared(spark, sf, "clean", lambda: C.clean_events(shop(spark, sf)))


@register("drop_duplicates", ["c_dedup"], "select * from c_dedup", floats=["price"])
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(shop(spark, sf))


@register("find_duplicates", ["shop"], """
 select * from (select *, count(*) over (partition by event_time, event_type, product_id, category_id,
   category_code, brand, price, user_id, user_session) as n_copies from shop) where n_copies > 1""", floats=["price"])
def q_find_duplicates(spark, sf):
    return C.find_duplicates(shop(spark, sf))


@register("drop_neg_price", ["c_pos"], "select * from c_pos", floats=["price"])
def q_drop_neg_price(spark, sf):
    return C.drop_neg_price(C.drop_duplicates(shop(spark, sf)))


@register("check_neg_price", ["c_dedup"], "select * from c_dedup where price < 0", floats=["price"])
def q_check_neg_price(spark, sf):
    return C.check_neg_price(C.drop_duplicates(shop(spark, sf)))


@register("split_category_code", ["c_split"], "select * from c_split", floats=["price"])
def q_split_category_code(spark, sf):
    return C.split_category_code(C.drop_neg_price(C.drop_duplicates(shop(spark, sf))))


@register("canonical_brand_first", ["c_canon"], "select * from c_canon")
def q_canonical_brand_first(spark, sf):
    return C.canonical_brand_first(
        C.split_category_code(C.drop_neg_price(C.drop_duplicates(shop(spark, sf)))))


@register("join_canonical_brand", ["c_brand"], "select * from c_brand", floats=["price"])
def q_join_canonical_brand(spark, sf):
    return C.fill_brand(C.split_category_code(C.drop_neg_price(C.drop_duplicates(shop(spark, sf)))))


@register("drop_cart_duplicates", ["c_brand"], """
 select * exclude (rn) from (select *, case when event_type = 'cart' then row_number() over (
   partition by event_type, product_id, user_id, user_session
   order by event_time, category_id nulls first, main_category nulls first, sub_category nulls first,
            brand nulls first, price nulls first) else 1 end as rn from c_brand) where rn = 1""", floats=["price"])
def q_drop_cart_duplicates(spark, sf):
    return C.drop_cart_duplicates(
        C.fill_brand(C.split_category_code(C.drop_neg_price(C.drop_duplicates(shop(spark, sf))))))


@register("clean_events", ["clean"], "select * from clean", floats=["price"])
def q_clean_events(spark, sf):
    return C.clean_events(shop(spark, sf))
