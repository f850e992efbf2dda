"""Registered queries: feature engineering."""

from __future__ import annotations

from shoplens.operators import features as FE
from shoplens.plans.q_clean import clean
from shoplens.plans.registry import register

PRODUCT_FLOATS = ["avg_price", "relative_price", "cart_per_view", "purchase_per_view",
                  "remove_per_cart", "purchase_per_cart"]
USER_FLOATS = ["avg_view_price", "avg_purchase_price", "avg_view_relative_price",
               "avg_purchase_relative_price", "cart_per_view", "purchase_per_view",
               "remove_per_cart", "purchase_per_cart"]


def enriched(spark, sf):
    """Clean events + relative_price (M3) as a shared stage table."""
    from shoplens.plans.stages import shared
    return shared(spark, sf, "enriched", lambda: FE.relative_price(clean(spark, sf)))


@register("category_price_quartiles", ["cat_q"],
          "select category_id, q1 as Q1, med as median, q3 as Q3, q3 - q1 as IQR from cat_q",
          floats=["Q1", "median", "Q3", "IQR"])
def q_category_price_quartiles(spark, sf):
    return FE.category_price_quartiles(clean(spark, sf))


@register("relative_price", ["rel"], "select * from rel", floats=["price", "relative_price"])
def q_relative_price(spark, sf):
    return FE.relative_price(clean(spark, sf))


@register("product_table", ["product_tbl"], "select * from product_tbl", floats=PRODUCT_FLOATS)
def q_product_table(spark, sf):
    return FE.product_table(enriched(spark, sf))


@register("user_table", ["user_tbl"], "select * from user_tbl", floats=USER_FLOATS)
def q_user_table(spark, sf):
    return FE.user_table(enriched(spark, sf))


@register("interaction_table", ["interaction"], "select * from interaction", floats=["interaction_score"])
def q_interaction_table(spark, sf):
    return FE.interaction_table(enriched(spark, sf))
