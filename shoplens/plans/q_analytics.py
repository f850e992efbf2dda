"""Registered queries: projection, filters, profiling, aggregates, windows,
top-k and set operations over shop events (SURVEY 2.2-2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import analytics as A
from shoplens.operators import clean as C
from shoplens.operators import features as FE
from shoplens.plans.q_clean import clean
from shoplens.functions.columns import PRICE_BINS
from shoplens.plans.registry import register
from shoplens.sources.fixtures import shop
from shoplens.sources.tables import load_table

# Fixed parameters of the category-specific reports (a category present in
# the fixture data, standing in for the reference's 'smartphone' and
# 'electronics').
SUB_VALUE = "blue.gizmo"
MAIN_VALUE = "large"


def split(spark, sf):
    """Distinct, non-negative, category-split raw events as a shared stage."""
    from shoplens.plans.stages import shared
    return shared(spark, sf, "split", lambda: C.split_category_code(
        C.drop_neg_price(C.drop_duplicates(shop(spark, sf)))))


def dist_prod(spark, sf):
    return A.first_row_per(split(spark, sf), "product_id", ["event_time"])


# ------------------------------------------------------------ projection
@register("project_reorder", ["clean"], "select product_id, user_id, event_type, price, date from clean",
          floats=["price"])
def q_project_reorder(spark, sf):
    return clean(spark, sf).select("product_id", "user_id", "event_type", "price", "date")


@register("drop_columns", ["clean"], "select * exclude (user_session, time) from clean", floats=["price"])
def q_drop_columns(spark, sf):
    return clean(spark, sf).drop("user_session", "time")


@register("rename", ["clean"], """
 select date as event_date, event_type as event, product_id, price as product_price from clean""",
          floats=["product_price"])
def q_rename(spark, sf):
    return (clean(spark, sf).select("date", "event_type", "product_id", "price")
            .withColumnsRenamed({"date": "event_date", "event_type": "event", "price": "product_price"}))


@register("filter_event_type", ["purch"], "select * from purch", floats=["price"])
def q_filter_event_type(spark, sf):
    return A.filter_event_type(clean(spark, sf), "purchase")


@register("non_purchase_events", ["clean"],
          "select * from clean where event_type is distinct from 'purchase'", floats=["price"])
def q_non_purchase_events(spark, sf):
    return A.filter_event_type(clean(spark, sf), "purchase", negate=True)


@register("zero_price", ["clean"], "select * from clean where price = 0", floats=["price"])
def q_zero_price(spark, sf):
    return A.zero_price(clean(spark, sf))


@register("customer_journey", ["clean"], "select * from clean", floats=["price"])
def q_customer_journey(spark, sf):
    return A.journey(clean(spark, sf), "user_session")


@register("product_journey", ["clean"], "select * from clean", floats=["price"])
def q_product_journey(spark, sf):
    return A.journey(clean(spark, sf), "product_id")


@register("price_history", ["c_split"], """
 select product_id, event_time, price from c_split
 where product_id in (select product_id from c_split where price = 0)""", floats=["price"])
def q_price_history(spark, sf):
    return A.price_history(split(spark, sf))


@register("invalid_datetime", ["clean"], """
 select * from clean where time is not null
  and try_strptime(cast(date as varchar) || ' ' || time, '%Y-%m-%d %H:%M:%S') is null""", floats=["price"])
def q_invalid_datetime(spark, sf):
    return A.invalid_datetime(clean(spark, sf))


@register("null_brand_rows", ["c_split"], "select * from c_split where brand is null", floats=["price"])
def q_null_brand_rows(spark, sf):
    return A.null_brand_rows(split(spark, sf))


@register("blank_brand_count", ["c_split"], """
 select count(*) filter (where brand is null or brand = '') as blank_brand_rows from c_split""")
def q_blank_brand_count(spark, sf):
    return A.blank_brand_count(split(spark, sf))


SUBSET_COLS = ["product_id", "category_id", "main_category", "sub_category", "brand", "event_type", "price"]


@register("subset_smartphone_top10", ["clean"], f"""
 select {', '.join(SUBSET_COLS)} from clean where sub_category = '{SUB_VALUE}'
 order by {', '.join(c + ' nulls first' for c in SUBSET_COLS)} limit 10""", floats=["price"])
def q_subset_top10(spark, sf):
    return A.subset_top(clean(spark, sf), "sub_category", SUB_VALUE, SUBSET_COLS, 10)


# ------------------------------------------------------------ profiling
@register("profile_count", ["clean"], "select count(*) as rows from clean")
def q_profile_count(spark, sf):
    return A.profile_count(clean(spark, sf))


_CLEAN_COLS = ["date", "weekday", "time", "event_type", "product_id", "category_id", "main_category",
               "sub_category", "brand", "price", "user_id", "user_session"]


@register("profile_non_null", ["clean"],
          "select " + ", ".join(f"count({c}) as {c}" for c in _CLEAN_COLS) + " from clean")
def q_profile_non_null(spark, sf):
    return A.profile_non_null(clean(spark, sf))


@register("profile_null_count", ["c_split"],
          "select " + ", ".join(f"count(*) filter (where {c} is null) as {c}" for c in C.SPLIT_COLUMNS)
          + " from c_split")
def q_profile_null_count(spark, sf):
    return A.profile_null_count(split(spark, sf))


_DESC_COLS = ["price", "weekday", "category_id"]


@register("profile_describe", ["clean"], " union all ".join(
    f"select '{c}' as \"column\", count({c}) as count, avg({c}::double) as mean, stddev_samp({c}::double) as std,"
    f" min({c})::double as min, quantile_cont({c}::double, 0.25) as p25, quantile_cont({c}::double, 0.5) as p50,"
    f" quantile_cont({c}::double, 0.75) as p75, max({c})::double as max from clean" for c in _DESC_COLS),
          floats=["mean", "std", "min", "p25", "p50", "p75", "max"])
def q_profile_describe(spark, sf):
    return A.profile_describe(clean(spark, sf), _DESC_COLS)


@register("profile_unique", ["clean"], "select distinct main_category from clean")
def q_profile_unique(spark, sf):
    return A.profile_unique(clean(spark, sf), "main_category")


@register("preview", ["clean"], "select * from clean order by " +
          ", ".join(c + " nulls first" for c in _CLEAN_COLS) + " limit 10", floats=["price"])
def q_preview(spark, sf):
    return A.preview(clean(spark, sf), 10)


# ------------------------------------------------------------ de-dup
@register("distinct_products", ["dist_prod"], "select * from dist_prod", floats=["price"])
def q_distinct_products(spark, sf):
    return dist_prod(spark, sf)


@register("distinct_pairs", ["clean"], "select distinct user_id, product_id from clean")
def q_distinct_pairs(spark, sf):
    return A.distinct_pairs(clean(spark, sf), ["user_id", "product_id"])


@register("win_row_number_dedup", ["clean"], "select distinct * from clean", floats=["price"])
def q_win_row_number_dedup(spark, sf):
    return C.drop_duplicates(clean(spark, sf))


# ------------------------------------------------------------ aggregates
@register("count_distinct_entities", ["c_dedup"], """
 select count(distinct user_id) as users, count(distinct product_id) as products,
  count(distinct category_id) as categories, count(distinct category_code) as taxonomies,
  count(distinct brand) as brands from c_dedup""")
def q_count_distinct_entities(spark, sf):
    return A.count_distinct_entities(shop(spark, sf))


@register("brand_nunique_per_product", ["c_split"],
          "select product_id, count(distinct brand) as n_brands from c_split group by product_id")
def q_brand_nunique(spark, sf):
    return A.brand_nunique_per_product(split(spark, sf))


@register("multi_brand_products", ["c_split"], """
 select product_id, count(*) as n_brand_values from (select distinct product_id, brand from c_split)
 group by product_id having count(*) > 1""")
def q_multi_brand_products(spark, sf):
    return A.multi_brand_products(split(spark, sf))


@register("canonical_brand_max", ["c_split"], "select product_id, max(brand) as brand from c_split group by product_id")
def q_canonical_brand_max(spark, sf):
    return C.canonical_brand_max(split(spark, sf))


@register("category_coverage", ["dist_prod"], """
 select *, 100.0 * with_code / nullif(with_code + without_code, 0) as pct_with_code,
  100.0 * without_code / nullif(with_code + without_code, 0) as pct_without_code,
  coalesce(100.0 * with_code / nullif(with_code + without_code, 0) < 50, false) as coverage_warning
 from (select count(*) filter (where main_category is not null and sub_category is not null) as with_code,
   count(*) filter (where main_category is null) as without_code,
   count(*) filter (where main_category is not null and sub_category is null) as main_only from dist_prod)""",
          floats=["pct_with_code", "pct_without_code"])
def q_category_coverage(spark, sf):
    return A.category_coverage(dist_prod(spark, sf))


@register("main_category_counts", ["c_split"], """
 select main_category, count(distinct product_id) as products from c_split
 where main_category is not null group by main_category""")
def q_main_category_counts(spark, sf):
    return A.distinct_products_per(split(spark, sf), "main_category")


@register("sub_category_counts", ["c_split"], """
 select sub_category, count(distinct product_id) as products from c_split
 where sub_category is not null group by sub_category""")
def q_sub_category_counts(spark, sf):
    return A.distinct_products_per(split(spark, sf), "sub_category")


@register("electronics_subcategories", ["c_split"], f"""
 select sub_category, count(distinct product_id) as products from c_split
 where main_category = '{MAIN_VALUE}' and sub_category is not null group by sub_category""")
def q_electronics_subcategories(spark, sf):
    return A.distinct_products_per(split(spark, sf).filter(F.col("main_category") == MAIN_VALUE), "sub_category")


_SUBC = """(select sub_category, count(distinct product_id) as products from c_split
   where sub_category is not null group by sub_category)"""


@register("topn_plus_other", ["c_split"], f"""
 with s as {_SUBC}, t as (select * from s order by products desc, sub_category limit 10)
 select sub_category, products from t
 union all
 select 'Other', (select sum(products) from s) - (select sum(products) from t)
 where (select sum(products) from s) - (select sum(products) from t) > 0""")
def q_topn_plus_other(spark, sf):
    c = A.distinct_products_per(split(spark, sf), "sub_category")
    return A.topn_plus_other(c, "sub_category", "products", 10, "Other").select(
        "sub_category", F.col("products").cast("bigint").alias("products"))


@register("shared_subcategories", ["c_split"], """
 with g as (select sub_category, main_category, count(*) as count from c_split
   where sub_category is not null and main_category is not null group by all)
 select * from g where sub_category in (select sub_category from g group by sub_category having count(*) > 1)""")
def q_shared_subcategories(spark, sf):
    return A.shared_subcategories(split(spark, sf))


@register("category_tree_counts", ["dist_prod"], """
 select main_category, sub_category, count(*) as count from dist_prod
 where main_category is not null and sub_category is not null group by all""")
def q_category_tree_counts(spark, sf):
    return A.category_tree_counts(dist_prod(spark, sf))


@register("inconsistent_category", ["dist_prod"], """
 select category_id, count(*) as n_codes from (select distinct category_id, sub_category from dist_prod)
 group by category_id having count(*) > 1""")
def q_inconsistent_category(spark, sf):
    return A.inconsistent_category(dist_prod(spark, sf))


@register("zero_price_stats", ["c_split"], """
 with p as (select product_id, bool_or(coalesce(price = 0, false)) as z,
   bool_or(coalesce(price = 0, false) and brand is null) as zn, bool_or(brand is null) as n
   from c_split group by product_id)
 select count(*) filter (where z) as zero_price_products,
  100.0 * (count(*) filter (where zn)) / nullif(count(*) filter (where z), 0) as pct_zero_no_brand,
  100.0 * (count(*) filter (where z)) / nullif(count(*), 0) as pct_zero_of_all,
  100.0 * (count(*) filter (where n)) / nullif(count(*), 0) as pct_no_brand_of_all from p""",
          floats=["pct_zero_no_brand", "pct_zero_of_all", "pct_no_brand_of_all"])
def q_zero_price_stats(spark, sf):
    return A.zero_price_stats(split(spark, sf))


@register("zero_price_by_main", ["c_split"], """
 with z as (select main_category, count(distinct product_id) as zero_price_products from c_split
   where price = 0 and main_category is not null group by main_category),
 a as (select main_category, count(distinct product_id) as products from c_split
   where main_category is not null group by main_category)
 select coalesce(z.main_category, a.main_category) as main_category, zero_price_products, products,
  100.0 * zero_price_products / nullif(products, 0) as percentage
 from z full outer join a on z.main_category = a.main_category""", floats=["percentage"])
def q_zero_price_by_main(spark, sf):
    return A.zero_price_by_main(split(spark, sf))


@register("percent_align", ["clean"], """
 with n as (select main_category, count(*) as purchases from clean where event_type = 'purchase'
   and main_category is not null group by 1),
 d as (select main_category, count(*) as views from clean where event_type = 'view'
   and main_category is not null group by 1)
 select coalesce(n.main_category, d.main_category) as main_category, purchases, views,
  100.0 * purchases / nullif(views, 0) as percentage from n full outer join d on n.main_category = d.main_category""",
          floats=["percentage"])
def q_percent_align(spark, sf):
    c = clean(spark, sf).filter(F.col("main_category").isNotNull())
    n = A.count_by(A.filter_event_type(c, "purchase"), "main_category", name="purchases")
    d = A.count_by(A.filter_event_type(c, "view"), "main_category", name="views")
    return A.percent_align(n, d, "main_category", "purchases", "views")


@register("zero_price_events", ["c_split"], """
 select event_type, count(*) as count from c_split where price = 0 group by event_type""")
def q_zero_price_events(spark, sf):
    return A.count_by(A.zero_price(split(spark, sf)), "event_type")


@register("always_zero_price", ["c_split"], """
 select product_id from c_split group by product_id having avg(price) = 0""")
def q_always_zero_price(spark, sf):
    return A.always_zero_price(split(spark, sf))


@register("median_price_by_brand", ["c_split"], """
 select brand, quantile_cont(price, 0.5) as median_price from c_split where brand is not null group by brand""",
          floats=["median_price"])
def q_median_price_by_brand(spark, sf):
    return A.median_price_by_brand(split(spark, sf))


def _range_sql(x):
    bins = (f"when {x} > {lo}" + (f" and {x} <= {hi}" if hi is not None else "") + f" then '{label}'"
            for lo, hi, label in PRICE_BINS)
    return f"case {' '.join(bins)} end"


@register("price_range_products", ["dist_prod"], f"""
 select price_range, count(*) as count from (select {_range_sql('price')} as price_range from dist_prod)
 where price_range is not null group by price_range""")
def q_price_range_products(spark, sf):
    return A.price_range_counts(dist_prod(spark, sf))


@register("price_range_purchases", ["purch"], f"""
 select price_range, count(*) as count from (select {_range_sql('price')} as price_range from purch)
 where price_range is not null group by price_range""")
def q_price_range_purchases(spark, sf):
    return A.price_range_counts(A.purchases(clean(spark, sf)))


@register("price_range_brands", ["c_split"], f"""
 select price_range, count(*) as count from (select {_range_sql('m')} as price_range from
  (select brand, quantile_cont(price, 0.5) as m from c_split where brand is not null group by brand))
 where price_range is not null group by price_range""")
def q_price_range_brands(spark, sf):
    return A.price_range_counts(A.median_price_by_brand(split(spark, sf)), "median_price")


@register("price_histogram", ["dist_prod"], """
 with x as (select price::double as x from dist_prod where price is not null and not isnan(price)),
 mm as (select min(x) as lo, max(x) as hi from x),
 c as (select case when hi = lo then 0 else least(cast(floor((x - lo) / ((hi - lo) / 50.0)) as integer), 49) end as bin,
   count(*) as count from x, mm group by 1),
 g as (select lo, hi, generate_series as bin from mm, generate_series(0, 49))
 select g.bin::integer as bin, lo + g.bin * ((hi - lo) / 50.0) as lower, lo + (g.bin + 1) * ((hi - lo) / 50.0) as upper,
  coalesce(c.count, 0) as count from g left join c on g.bin = c.bin""", floats=["lower", "upper"])
def q_price_histogram(spark, sf):
    return A.price_histogram(dist_prod(spark, sf), 50)


@register("event_mix", ["clean"], """
 select event_type, count(*) as count, count(*) / sum(count(*)) over () as share from clean group by event_type""",
          floats=["share"])
def q_event_mix(spark, sf):
    return A.event_mix(clean(spark, sf))


def _events_by_sql(key_expr, key):
    ts = ["view", "cart", "purchase"]
    cnt = ", ".join(f"count(*) filter (where event_type = '{t}') as {t}" for t in ts)
    pct = ", ".join(f"{t} / nullif(sum({t}) over (), 0) as {t}_percent" for t in ts)
    return f"select {key}, {', '.join(ts)}, {pct} from (select {key_expr} as {key}, {cnt} from clean group by 1)"


@register("events_by_hour", ["clean"], _events_by_sql("cast(substr(time, 1, 2) as integer)", "hour"),
          floats=["view_percent", "cart_percent", "purchase_percent"])
def q_events_by_hour(spark, sf):
    return A.events_by(clean(spark, sf), A.hour_of_time(), "hour")


@register("events_by_weekday", ["clean"], _events_by_sql("weekday", "weekday"),
          floats=["view_percent", "cart_percent", "purchase_percent"])
def q_events_by_weekday(spark, sf):
    return A.events_by(clean(spark, sf), F.col("weekday"), "weekday")


@register("top_sellers", ["purch"], """
 select brand, count(*) as purchases from purch where brand is not null group by brand
 order by purchases desc, brand limit 20""")
def q_top_sellers(spark, sf):
    return A.top_sellers(clean(spark, sf), 20)


@register("brand_word_freq", ["purch"], """
 select word, count(*) as freq from (select unnest(string_split(brand, ' ')) as word from purch
  where brand is not null) where length(word) > 0 group by word""")
def q_brand_word_freq(spark, sf):
    return A.brand_word_freq(clean(spark, sf))


@register("top_categories", ["purch"], """
 select category_id, arg_min(main_category, (date, time, product_id, user_id, price)) as main_category,
  arg_min(sub_category, (date, time, product_id, user_id, price)) as sub_category, count(*) as count
 from purch group by category_id""")
def q_top_categories(spark, sf):
    return A.top_categories(clean(spark, sf))


@register("orders_by_category_brand", ["purch"], """
 select category_id, main_category, sub_category, brand, count(*) as orders from purch
 where category_id is not null and main_category is not null and sub_category is not null and brand is not null
 group by all""")
def q_orders_by_category_brand(spark, sf):
    return A.orders_by_category_brand(clean(spark, sf))


@register("smartphone_market_share", ["purch"], f"""
 with s as (select brand, count(*) as orders from purch where category_id is not null and main_category is not null
   and sub_category is not null and brand is not null and main_category = '{MAIN_VALUE}' group by brand),
 t as (select * from s order by orders desc, brand limit 10)
 select brand, orders from t union all
 select 'Others', (select sum(orders) from s) - (select sum(orders) from t)
 where (select sum(orders) from s) - (select sum(orders) from t) > 0""")
def q_smartphone_market_share(spark, sf):
    return A.market_share(clean(spark, sf), "main_category", MAIN_VALUE, 10).select(
        "brand", F.col("orders").cast("bigint").alias("orders"))


_WD = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"


@register("orders_per_weekday_top_brands", ["purch"], f"""
 with o as (select weekday, brand, count(*) as orders from purch where brand is not null group by all),
 t as (select brand from o group by brand order by sum(orders) desc, brand limit 10)
 select {_WD}[weekday + 1] as weekday, brand, orders from o where brand in (select brand from t)""")
def q_orders_per_weekday_top_brands(spark, sf):
    return A.orders_per_weekday_top_brands(clean(spark, sf), 10)


@register("revenue_by_brand", ["clean"], """
 select brand, sum(price) as monthly_revenue from clean where brand is not null group by brand""",
          floats=["monthly_revenue"])
def q_revenue_by_brand(spark, sf):
    return A.revenue_by_brand(clean(spark, sf))


@register("revenue_by_brand_purchases", ["purch"], """
 select brand, sum(price) as monthly_revenue from purch where brand is not null group by brand""",
          floats=["monthly_revenue"])
def q_revenue_by_brand_purchases(spark, sf):
    return A.revenue_by_brand(clean(spark, sf), purchases_only=True)


@register("daily_revenue_top5", ["clean"], """
 with d as (select date, brand, sum(price) as daily_revenue from clean where brand is not null group by all),
 t as (select brand from d group by brand order by sum(daily_revenue) desc, brand limit 5)
 select * from d where brand in (select brand from t)""", floats=["daily_revenue"])
def q_daily_revenue_top5(spark, sf):
    return A.daily_revenue_top(clean(spark, sf), 5)


@register("avg_price_by_product", ["clean"], """
 select product_id, category_id, main_category, sub_category, avg(price) as product_avg_price
 from clean group by all""", floats=["product_avg_price"])
def q_avg_price_by_product(spark, sf):
    return A.avg_price_by(clean(spark, sf), ["product_id", "category_id", "main_category", "sub_category"])


@register("avg_price_by_product_brand", ["pbb"], "select * from pbb", floats=["product_avg_price"])
def q_avg_price_by_product_brand(spark, sf):
    return A.avg_price_by(clean(spark, sf), A.PRODUCT_BRAND_KEYS)


@register("win_count_partition", ["pbb"], """
 select *, count(*) over (partition by product_id) as number_brands from pbb""", floats=["product_avg_price"])
def q_win_count_partition(spark, sf):
    return A.brands_per_product_rows(clean(spark, sf))


@register("multi_brand_count", ["pbb"], """
 select count(*) filter (where number_brands = 2) as rows_with_two_brands from
 (select *, count(*) over (partition by product_id) as number_brands from pbb)""")
def q_multi_brand_count(spark, sf):
    return A.multi_brand_count(clean(spark, sf))


@register("product_funnel", ["clean"], """
 select product_id, category_id, main_category, sub_category, brand, avg(price) as product_avg_price,
  count(*) filter (where event_type = 'view') as product_total_views,
  count(*) filter (where event_type = 'cart') as product_total_carts,
  count(*) filter (where event_type = 'purchase') as product_total_purchases,
  case when count(*) filter (where event_type = 'cart') > 0 then
   (count(*) filter (where event_type = 'purchase'))::double / (count(*) filter (where event_type = 'cart'))
   else 0.0 end as cart_conversion
 from clean where user_session is not null group by all""",
          floats=["product_avg_price", "cart_conversion"])
def q_product_funnel(spark, sf):
    return A.product_funnel(clean(spark, sf))


@register("semi_join_session", ["clean"], """
 select * from clean where user_session in (select distinct user_session from clean)""", floats=["price"])
def q_semi_join_session(spark, sf):
    return A.semi_join_session(clean(spark, sf))


@register("smartphone_event_counts", ["clean"], f"""
 select product_id, sub_category, event_type, count(event_type) as event_count from clean
 where sub_category = '{SUB_VALUE}' group by all""")
def q_smartphone_event_counts(spark, sf):
    return A.level_event_counts(clean(spark, sf), "sub_category", SUB_VALUE)


# the (product, event type) pairs of the category whose count no other exceeds
_PAIRS = f"""select main_category, product_id, event_type, sum(case when event_type is null then 0 else 1 end)::bigint as event_count
  from clean where main_category = '{MAIN_VALUE}' group by all"""
_MAXEC = f"""(select product_id, main_category, event_type, event_count from ({_PAIRS}) a
  where event_count = (select max(event_count) from ({_PAIRS}) b))"""


@register("win_rank_agg", ["clean"], f"select * from {_MAXEC}")
def q_win_rank_agg(spark, sf):
    return A.max_event_products(clean(spark, sf), "main_category", MAIN_VALUE)


@register("inner_join_max_events", ["clean"], f"""
 select o.*, m.event_type as max_event_type, m.event_count from clean o
 join {_MAXEC} m on o.product_id = m.product_id and o.main_category = m.main_category
 where o.main_category = '{MAIN_VALUE}'""", floats=["price"])
def q_inner_join_max_events(spark, sf):
    c = clean(spark, sf)
    m = A.max_event_products(c, "main_category", MAIN_VALUE).withColumnRenamed("event_type", "max_event_type")
    return c.filter(F.col("main_category") == MAIN_VALUE).join(m, ["product_id", "main_category"], "inner") \
            .select(*c.columns, "max_event_type", "event_count")


@register("popularity_score", ["clean"], f"""
 with top as {_MAXEC},
 e as (select c.*, top.event_count, c.event_type = 'view' as is_view, c.event_type = 'purchase' as is_purchase,
   c.event_type not in ('cart', 'purchase') as is_other from clean c join top using (product_id, main_category)),
 s as (select product_id, category_id, main_category, sub_category, brand, event_count,
   avg(price) as product_avg_price, count_if(is_view) as product_total_views,
   count_if(event_type = 'cart') as product_total_carts, count_if(is_purchase) as product_total_purchases,
   sum(case when is_view then 2 else 0 end + case when is_other then 3 else 0 end
       + case when is_purchase then 5 else 0 end) / 10.0 as points from e group by all)
 select * exclude (points), points / event_count as popularity_score from s""",
          floats=["product_avg_price", "popularity_score"])
def q_popularity_score(spark, sf):
    return A.popularity_score(clean(spark, sf), "main_category", MAIN_VALUE)


@register("regression_metrics", [], """
 select avg(abs(l_quantity * 1500.0 - l_extendedprice)) as mae,
  avg((l_quantity * 1500.0 - l_extendedprice) * (l_quantity * 1500.0 - l_extendedprice)) as mse,
  sqrt(avg((l_quantity * 1500.0 - l_extendedprice) * (l_quantity * 1500.0 - l_extendedprice))) as rmse
 from lineitem""", floats=["mae", "mse", "rmse"])
def q_regression_metrics(spark, sf):
    li = load_table(spark, sf, "lineitem").select(
        "l_extendedprice", (F.col("l_quantity") * F.lit(1500.0)).alias("prediction"))
    return A.regression_metrics(li, "l_extendedprice", "prediction")


# ------------------------------------------------------------ sort / top-k / sets
@register("sort_interactions", ["interaction"], "select * from interaction", floats=["interaction_score"])
def q_sort_interactions(spark, sf):
    from shoplens.plans.q_features import enriched
    return FE.interaction_table(enriched(spark, sf)).orderBy(F.desc("interaction_score"), "user_id", "product_id")


@register("sort_events", ["clean"], "select * from clean", floats=["price"])
def q_sort_events(spark, sf):
    c = clean(spark, sf)
    return c.orderBy("date", "time", *[F.col(x).asc_nulls_first() for x in c.columns if x not in ("date", "time")])


@register("topk_brands", ["purch"], """
 select brand, count(*) as orders from purch where brand is not null group by brand
 order by orders desc, brand limit 10""")
def q_topk_brands(spark, sf):
    g = A.count_by(A.purchases(clean(spark, sf)).filter(F.col("brand").isNotNull()), "brand", name="orders")
    return A.top_groups(g, "brand", "orders", 10)


@register("topk_groups", ["clean"], """
 select brand, sum(price) as monthly_revenue from clean where brand is not null group by brand
 order by monthly_revenue desc, brand limit 10""", floats=["monthly_revenue"])
def q_topk_groups(spark, sf):
    return A.top_groups(A.revenue_by_brand(clean(spark, sf)), "brand", "monthly_revenue", 10)


@register("append_other_row", ["purch"], """
 with s as (select category_id, count(*) as count from purch group by category_id),
 t as (select * from s order by count desc, category_id::varchar limit 10)
 select cast(category_id as varchar) as category, count from t union all
 select 'Others', (select sum(count) from s) - (select sum(count) from t)
 where (select sum(count) from s) - (select sum(count) from t) > 0""")
def q_append_other_row(spark, sf):
    tc = A.top_categories(clean(spark, sf)).select(F.col("category_id").cast("string").alias("category"), "count")
    return A.topn_plus_other(tc, "category", "count", 10, "Others").select(
        "category", F.col("count").cast("bigint").alias("count"))


@register("union_cart_split", ["c_brand"], """
 select event_time, event_type, product_id, category_id, main_category, sub_category, brand, price, user_id, user_session
 from (select *, row_number() over (partition by product_id, user_id, user_session
        order by event_time, category_id nulls first, main_category nulls first, sub_category nulls first,
                 brand nulls first, price nulls first) as rn
       from c_brand where event_type = 'cart') where rn = 1
 union all select * from c_brand where event_type is null or event_type <> 'cart'""", floats=["price"])
def q_union_cart_split(spark, sf):
    df = C.fill_brand(split(spark, sf))
    return C.drop_cart_duplicates(df)
