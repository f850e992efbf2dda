"""Registered queries: sinks (write, then read back what was written) and
the incremental job (SURVEY 2.1, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.operators import clean as C
from shoplens.operators import features as FE
from shoplens.plans import pipelines
from shoplens.plans.q_clean import clean
from shoplens.plans.registry import register
from shoplens.session import scratch_path
from shoplens.sources import files
from shoplens.sources.fixtures import shop
from shoplens.sources.schemas import RAW_EVENT


@register("sink_clean", ["clean"], "select * from clean", floats=["price"])
def q_sink_clean(spark, sf):
    path = files.fresh_path(spark, "clean")
    pipelines.clean_job(shop(spark, sf), path)
    return spark.read.parquet(path)


@register("src_events_csv", ["shop"], """
 select date_trunc('second', event_time) as event_time, event_type, product_id, category_id, category_code,
  brand, price, user_id, user_session from shop""", floats=["price"])
def q_src_events_csv(spark, sf):
    path = files.fresh_path(spark, "events-csv")
    files.write_events_csv(shop(spark, sf), path)
    return files.read_events_csv(spark, path)


@register("sink_features", ["product_tbl"], "select * from product_tbl",
          floats=["avg_price", "relative_price", "cart_per_view", "purchase_per_view", "remove_per_cart",
                  "purchase_per_cart"])
def q_sink_features(spark, sf):
    base = files.fresh_path(spark, "features")
    cpath = f"{base}/clean"
    pipelines.clean_job(shop(spark, sf), cpath)
    out = pipelines.feature_job(spark, cpath, f"{base}/out")
    return spark.read.parquet(out["product"])


@register("sink_descriptions", ["docs"], "select product_id, description from docs")
def q_sink_descriptions(spark, sf):
    from shoplens.plans.q_search import docs
    path = files.fresh_path(spark, "descriptions")
    files.write_table(docs(spark, sf).select("product_id", "description"), path)
    return spark.read.parquet(path)


@register("sink_catalog", ["cat_products"], "select * from cat_products",
          floats=["discounted_price", "actual_price", "discount_percentage", "rating", "rating_count"])
def q_sink_catalog(spark, sf):
    from shoplens.plans.q_catalog import products
    path = files.fresh_path(spark, "catalog")
    files.write_table(products(spark, sf), path)
    return spark.read.parquet(path)


@register("sink_eda_checkpoint", ["c_split"], "select * from c_split", floats=["price"])
def q_sink_eda_checkpoint(spark, sf):
    from shoplens.plans.q_analytics import split
    path = files.fresh_path(spark, "eda")
    files.write_table(split(spark, sf), path)
    return spark.read.parquet(path)


#: Bytes of a row group of the raw files: a task reads row groups, so the file of a large day is read by several.
ROW_GROUP = 4 << 20


def write_days(events, raw_dir):
    """Raw events as one file per day."""
    (events.withColumn("day", F.to_date("event_time").cast("string"))
     .repartition("day").write.option("parquet.block.size", ROW_GROUP).partitionBy("day").parquet(raw_dir))


@register("job_monthly_incremental", ["clean_day"], "select * from clean_day", floats=["price"])
def q_job_monthly_incremental(spark, sf):
    """Raw events written one file per day, then cleaned file by file by an
    availableNow stream; the brand fill sees one file at a time, as the
    reference's per-file job does."""
    from shoplens.streaming.incremental import clean_new_files
    base = files.fresh_path(spark, "incremental")
    raw_dir = f"{base}/raw"
    write_days(shop(spark, sf), raw_dir)
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("day", T.StringType())])
    out = f"{base}/clean"
    clean_new_files(spark, raw_dir, schema, out, f"{base}/checkpoint", files_per_batch=1, drop_cols=("day",))
    return spark.read.parquet(out).drop("batch").select(*C.CLEAN_COLUMNS)


@register("job_monthly_features", ["clean_day"], """
 select user_id, product_id, greatest(0::double, least(100::double, sum(
   (case event_type when 'view' then 0.1 when 'cart' then 0.4 when 'remove_from_cart' then -0.3
     when 'purchase' then 1.0 else 0.0 end)::double))) as interaction_score
 from clean_day group by user_id, product_id, date""", floats=["interaction_score"])
def q_job_monthly_features(spark, sf):
    """The interaction scores that the incremental job builds for each file
    (a day here, so all its events have the weight of the last day)."""
    from shoplens.streaming.incremental import clean_new_files
    base = files.fresh_path(spark, "incremental")
    raw_dir = f"{base}/raw"
    write_days(shop(spark, sf), raw_dir)
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("day", T.StringType())])
    clean_new_files(spark, raw_dir, schema, f"{base}/clean", f"{base}/checkpoint", files_per_batch=1,
                    drop_cols=("day",), features_dir=f"{base}/features", features=("interaction",))
    return spark.read.parquet(f"{base}/features/interaction").select("user_id", "product_id", "interaction_score")


@register("job_monthly_state", ["clean_day"], """
 select user_id, product_id, greatest(0::double, least(100::double, sum(
   (case event_type when 'view' then 0.1 when 'cart' then 0.4 when 'remove_from_cart' then -0.3
     when 'purchase' then 1.0 else 0.0 end)::double
   * exp(ln(0.5) * date_diff('day', date, (select max(date) from clean_day))::double / 15.0)))) as interaction_score
 from clean_day group by user_id, product_id""", floats=["interaction_score"])
def q_job_monthly_state(spark, sf):
    """The interaction scores of all files together, from the state that the
    incremental job adds each file to."""
    from shoplens.operators.decayed import state_scores
    from shoplens.streaming.incremental import clean_new_files
    base = files.fresh_path(spark, "incremental")
    raw_dir = f"{base}/raw"
    write_days(shop(spark, sf), raw_dir)
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("day", T.StringType())])
    clean_new_files(spark, raw_dir, schema, f"{base}/clean", f"{base}/checkpoint", files_per_batch=1,
                    drop_cols=("day",), state_dir=f"{base}/state", compact_every=8)
    return state_scores(spark, f"{base}/state")


@register("recency_days_coef", ["rel"], """
 select user_id, product_id, event_type, date, date_diff('day', date, (select max(date) from rel)) as recency,
  exp(ln(0.5) * date_diff('day', date, (select max(date) from rel))::double / 15.0) as recency_coef from rel""",
          floats=["recency_coef"])
def q_recency_days_coef(spark, sf):
    from shoplens.plans.q_features import enriched
    return FE.recency(enriched(spark, sf)).select("user_id", "product_id", "event_type", "date", "recency",
                                                  "recency_coef")


@register("interaction_rates", ["prod_base"], """
 select product_id, 100.0 * (case when views = 0 then carts::double else carts / views end) as cart_per_view,
  100.0 * (case when views = 0 then purchases::double else purchases / views end) as purchase_per_view,
  100.0 * (case when carts = 0 then remove_from_carts::double else remove_from_carts / carts end) as remove_per_cart,
  100.0 * (case when carts = 0 then purchases::double else purchases / carts end) as purchase_per_cart
 from prod_base""", floats=["cart_per_view", "purchase_per_view", "remove_per_cart", "purchase_per_cart"])
def q_interaction_rates(spark, sf):
    from shoplens.functions.columns import rate_or_count
    from shoplens.plans.q_features import enriched
    e = enriched(spark, sf)
    g = e.groupBy("product_id").agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in zip(
        C.EVENT_TYPES, FE.COUNT_COLUMNS)])
    return g.select("product_id", rate_or_count("carts", "views").alias("cart_per_view"),
                    rate_or_count("purchases", "views").alias("purchase_per_view"),
                    rate_or_count("remove_from_carts", "carts").alias("remove_per_cart"),
                    rate_or_count("purchases", "carts").alias("purchase_per_cart"))


@register("format_time_date", ["clean"], """
 select product_id, category_id, main_category, sub_category, brand, time, strftime(date, '%d/%m/%Y') as date
 from clean""")
def q_format_time_date(spark, sf):
    return clean(spark, sf).select("product_id", "category_id", "main_category", "sub_category", "brand", "time",
                                   F.date_format("date", "dd/MM/yyyy").alias("date"))


@register("date_to_string", ["clean"], "select cast(date as varchar) as date, event_type, product_id from clean")
def q_date_to_string(spark, sf):
    return clean(spark, sf).select(F.col("date").cast("string").alias("date"), "event_type", "product_id")


@register("split_datetime", ["c_dedup"], """
 select cast(event_time as date) as date, cast(isodow(event_time) - 1 as integer) as weekday,
  strftime(event_time, '%H:%M:%S') as time, event_type, product_id, category_id, brand, price, user_id, user_session
 from c_dedup""", floats=["price"])
def q_split_datetime(spark, sf):
    return C.split_datetime(C.drop_duplicates(shop(spark, sf)))


@register("update_join", ["c_split"], """
 select s.* replace (coalesce(b.brand, s.brand) as brand) from c_split s
 left join (select product_id, max(brand) as brand from c_split group by product_id) b on s.product_id = b.product_id""",
          floats=["price"])
def q_update_join(spark, sf):
    from shoplens.plans.q_analytics import split
    s = split(spark, sf)
    return C.fill_brand(s, C.canonical_brand_max(s).withColumnRenamed("brand", "canonical_brand"))


@register("brand_fill_audit", ["c_split"], """
 select o.* from c_split o join (select product_id, max(brand) as brand from c_split group by product_id) n
 on o.product_id = n.product_id where coalesce(o.brand, '') = '' and coalesce(n.brand, '') <> ''""",
          floats=["price"])
def q_brand_fill_audit(spark, sf):
    from shoplens.plans.q_analytics import split
    s = split(spark, sf)
    n = C.canonical_brand_max(s).withColumnRenamed("brand", "_nb")
    return s.join(n, "product_id").filter(
        (F.coalesce(F.col("brand"), F.lit("")) == "") & (F.coalesce(F.col("_nb"), F.lit("")) != "")
    ).select(*s.columns)


@register("fill_zero", ["clean"], """
 select p.product_id, coalesce(c.purchases, 0) as purchases from (select distinct product_id from clean) p
 left join (select product_id, count(*) as purchases from clean where event_type = 'purchase' group by 1) c
 on p.product_id = c.product_id""")
def q_fill_zero(spark, sf):
    c = clean(spark, sf)
    pur = c.filter(F.col("event_type") == "purchase").groupBy("product_id").agg(F.count(F.lit(1)).alias("purchases"))
    return c.select("product_id").distinct().join(pur, "product_id", "left").na.fill(0, ["purchases"])


@register("share_of_total", ["clean"], """
 select brand, count(*) as events, count(*) / sum(count(*)) over () as share from clean
 where brand is not null group by brand""", floats=["share"])
def q_share_of_total(spark, sf):
    g = clean(spark, sf).filter(F.col("brand").isNotNull()).groupBy("brand").agg(F.count(F.lit(1)).alias("events"))
    return FE.with_scalars(g, g.agg(F.sum("events").alias("_t"))).select("brand", "events", (F.col("events") / F.col("_t")).alias("share"))


@register("weekday_name", ["clean"], f"""
 select distinct weekday, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][weekday + 1] as name
 from clean""")
def q_weekday_name(spark, sf):
    from shoplens.functions.columns import weekday_name
    return clean(spark, sf).select("weekday", weekday_name("weekday").alias("name")).distinct()


@register("hour_of_day", ["clean"], """
 select cast(substr(time, 1, 2) as integer) as hour, count(*) as events from clean group by 1""")
def q_hour_of_day(spark, sf):
    from shoplens.operators.analytics import hour_of_time
    return clean(spark, sf).groupBy(hour_of_time().alias("hour")).agg(F.count(F.lit(1)).alias("events"))


@register("weighted_rates", ["prod_base"], """
 with r0 as (select product_id, views, carts,
   100.0 * (case when views = 0 then carts::double else carts / views end) as r_cv,
   100.0 * (case when carts = 0 then purchases::double else purchases / carts end) as r_pc from prod_base),
 tot as (select sum(views) as tv, sum(carts) as tc from prod_base)
 select product_id, coalesce(r_cv * (case when tv = 0 then null else views / tv end), 0) as cart_per_view,
  coalesce(r_pc * (case when tc = 0 then null else carts / tc end), 0) as purchase_per_cart from r0, tot""",
          floats=["cart_per_view", "purchase_per_cart"])
def q_weighted_rates(spark, sf):
    from shoplens.functions.columns import rate_or_count, safe_div
    from shoplens.plans.q_features import enriched
    e = enriched(spark, sf)
    g = e.groupBy("product_id").agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in zip(
        C.EVENT_TYPES, FE.COUNT_COLUMNS)])
    j = FE.with_scalars(g, g.agg(F.sum("views").alias("_tv"), F.sum("carts").alias("_tc")))
    return j.select("product_id",
                    F.coalesce(rate_or_count("carts", "views") * safe_div(F.col("views"), F.col("_tv")),
                               F.lit(0.0)).alias("cart_per_view"),
                    F.coalesce(rate_or_count("purchases", "carts") * safe_div(F.col("carts"), F.col("_tc")),
                               F.lit(0.0)).alias("purchase_per_cart"))


@register("min_max_normalise", ["prod_base"], """
 select product_id, (views - min(views) over ()) / nullif((max(views) over () - min(views) over ())::double, 0) as views,
  (avg_price - min(avg_price) over ()) / nullif(max(avg_price) over () - min(avg_price) over (), 0) as avg_price
 from prod_base""", floats=["views", "avg_price"])
def q_min_max_normalise(spark, sf):
    from shoplens.plans.q_features import enriched
    g = enriched(spark, sf).groupBy("product_id").agg(
        F.count_if(F.col("event_type") == "view").alias("views"), F.avg("price").alias("avg_price"))
    return FE.min_max_normalise(g, ["views", "avg_price"])


@register("weighted_score_clamp", ["interaction"], """
 select count(*) filter (where interaction_score = 0) as at_zero, count(*) filter (where interaction_score = 100)
  as at_hundred, count(*) as pairs from interaction""")
def q_weighted_score_clamp(spark, sf):
    from shoplens.plans.q_features import enriched
    i = FE.interaction_table(enriched(spark, sf))
    return i.agg(F.count_if(F.col("interaction_score") == 0).alias("at_zero"),
                 F.count_if(F.col("interaction_score") == 100).alias("at_hundred"),
                 F.count(F.lit(1)).alias("pairs"))


@register("cast_user_table", ["user_tbl"], """
 select * replace (views::int as views, carts::int as carts, remove_from_carts::int as remove_from_carts,
  purchases::int as purchases, distinct_view_product::int as distinct_view_product,
  distinct_cart_product::int as distinct_cart_product, distinct_remove_product::int as distinct_remove_product,
  distinct_purchase_product::int as distinct_purchase_product) from user_tbl""",
          floats=["avg_view_price", "avg_purchase_price", "avg_view_relative_price", "avg_purchase_relative_price",
                  "cart_per_view", "purchase_per_view", "remove_per_cart", "purchase_per_cart"])
def q_cast_user_table(spark, sf):
    from shoplens.plans.q_features import enriched
    return FE.cast_user_table(FE.user_table(enriched(spark, sf)))


@register("user_table_strict", ["user_base"], """
 select user_id, first_date, last_date, views, case when views > 0 then carts else 0 end as carts,
  case when views > 0 then purchases else 0 end as purchases,
  case when views > 0 then avg_purchase_price else 0 end as avg_purchase_price from user_base""",
          floats=["avg_purchase_price"])
def q_user_table_strict(spark, sf):
    """Users without a view have zeros everywhere."""
    from shoplens.plans.q_features import enriched
    return FE.user_table(enriched(spark, sf), strict=True).select(
        "user_id", "first_date", "last_date", "views", "carts", "purchases", "avg_purchase_price")


@register("src_catalog_web", ["docs"], "select * from docs",
          floats=["discounted_price", "actual_price", "discount_percentage", "rating", "rating_count"])
def q_src_catalog_web(spark, sf):
    """The search-ready catalogue (product rows + description) as the web
    page loads it: written once as parquet, read back."""
    from shoplens.plans.q_search import docs
    path = files.fresh_path(spark, "catalog-web")
    files.write_table(docs(spark, sf), path)
    return spark.read.parquet(path)


@register("drop_remove_cart_duplicates", ["c_brand"], """
 select event_time, event_type, product_id, category_id, main_category, sub_category, brand, price, user_id, user_session
 from (select *, row_number() over (partition by product_id, user_id, user_session
        order by event_time, category_id nulls first, main_category nulls first, sub_category nulls first,
                 brand nulls first, price nulls first) as rn
       from c_brand where event_type = 'remove_from_cart') where rn = 1
 union all select * from c_brand where event_type is null or event_type <> 'remove_from_cart'""", floats=["price"])
def q_drop_remove_cart_duplicates(spark, sf):
    from shoplens.plans.q_analytics import split
    return C.drop_remove_cart_duplicates(C.fill_brand(split(spark, sf)), keep="first")


@register("join_category_stats", ["clean", "cat_q"], """
 select c.product_id, c.user_id, c.category_id, c.price, q.q1 as Q1, q.med as median, q.q3 as Q3
 from clean c left join cat_q q on c.category_id = q.category_id""",
          floats=["price", "Q1", "median", "Q3"])
def q_join_category_stats(spark, sf):
    c = clean(spark, sf)
    q = FE.category_price_quartiles(c)
    return c.join(q, "category_id", "left").select("product_id", "user_id", "category_id", "price", "Q1",
                                                   "median", "Q3")


@register("user_interaction", ["rel"], """
 select user_id,
  count(*) filter (where event_type = 'view') as views,
  count(*) filter (where event_type = 'cart') as carts,
  count(*) filter (where event_type = 'remove_from_cart') as remove_from_carts,
  count(*) filter (where event_type = 'purchase') as purchases,
  coalesce(avg(price) filter (where event_type = 'view'), 0) as avg_view_price,
  coalesce(avg(price) filter (where event_type = 'cart'), 0) as avg_purchase_price,
  coalesce(avg(relative_price) filter (where event_type = 'view'), 0) as avg_view_relative_price,
  coalesce(avg(relative_price) filter (where event_type = 'cart'), 0) as avg_purchase_relative_price,
  count(distinct product_id) filter (where event_type = 'view') as distinct_view_product,
  count(distinct product_id) filter (where event_type = 'cart') as distinct_cart_product,
  count(distinct product_id) filter (where event_type = 'remove_from_cart') as distinct_remove_product,
  count(distinct product_id) filter (where event_type = 'purchase') as distinct_purchase_product
 from rel group by user_id""",
          floats=["avg_view_price", "avg_purchase_price", "avg_view_relative_price", "avg_purchase_relative_price"])
def q_user_interaction(spark, sf):
    from shoplens.plans.q_features import enriched
    return FE.user_interaction(enriched(spark, sf))


@register("truncate_name", ["catalog_raw"], """
 select product_id, case when length(about_product) > 300 then substr(about_product, 1, 300) || '...'
  else about_product end as short_text from catalog_raw""")
def q_truncate_name(spark, sf):
    from shoplens.functions.columns import truncate_text
    from shoplens.sources.fixtures import catalog
    return catalog(spark, sf).select("product_id", truncate_text("about_product", 300).alias("short_text"))


@register("star_bar", ["cat_typed"], """
 select product_id, rating, repeat('★', least(greatest(cast(floor(rating) as integer), 0), 5))
  || repeat('☆', 5 - least(greatest(cast(floor(rating) as integer), 0), 5)) as stars from cat_typed""",
          floats=["rating"])
def q_star_bar(spark, sf):
    from shoplens.functions.columns import star_bar
    from shoplens.operators import catalog as K
    from shoplens.sources.fixtures import catalog
    df = K.fill_rating(K.numeric_processing(catalog(spark, sf).dropDuplicates()))
    return df.select("product_id", "rating", star_bar("rating").alias("stars"))


@register("count_commas", ["catalog_raw"], """
 select product_id, length(user_id) - length(replace(user_id, ',', '')) as id_commas,
  length(user_name) - length(replace(user_name, ',', '')) as name_commas from catalog_raw""")
def q_count_commas(spark, sf):
    from shoplens.functions.columns import count_char
    from shoplens.sources.fixtures import catalog
    return catalog(spark, sf).select("product_id", count_char("user_id", ",").cast("bigint").alias("id_commas"),
                                     count_char("user_name", ",").cast("bigint").alias("name_commas"))
