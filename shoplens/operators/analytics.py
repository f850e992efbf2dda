"""Market and behaviour analytics over clean events.

Conventions: group keys that are null are dropped where the definition drops
them; every top-k has a unique tie-break; global shares use a 1-row total
(a window without PARTITION BY only over a few grouped rows: event types,
hours, weekdays); top-n lists are TakeOrdered (bounded k rows) joined back by
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.columns import price_range, safe_div, weekday_name
from shoplens.operators.features import with_scalars
from shoplens.operators.quantiles import exact_quantiles


def _is(c: str, v) -> F.Column:
    return F.coalesce(F.col(c) == v, F.lit(False))


# ------------------------------------------------------------ profiling
def profile_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def profile_non_null(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])


def profile_null_count(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def profile_describe(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column, one
    output row per column. The columns are unpivoted into (column, x), so one
    aggregate serves them all; quartiles are exact ranks (``exact_quantiles``)
    unless ``approx``, which takes a quantile sketch."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                      for c in cols])).alias("_s")).select("_s.column", "_s.x")
    aggs = [F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"), F.max("x").alias("max")]
    names = ["p25", "p50", "p75"]
    if approx:
        g = x.groupBy("column").agg(*aggs, F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            "*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        g = x.groupBy("column").agg(*aggs).join(
            exact_quantiles(x, "column", "x", dict(zip(names, (0.25, 0.5, 0.75)))), "column", "left")
    return g.select("column", "count", "mean", "std", "min", *names, "max")


def profile_unique(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def preview(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """First n rows under a total order (all columns break ties)."""
    order = order or df.columns
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)


# ------------------------------------------------------------ filters
def filter_event_type(df: DataFrame, event_type: str = "purchase", negate: bool = False) -> DataFrame:
    """Equality on event_type; the negation keeps null types like pandas."""
    eq = F.col("event_type").eqNullSafe(event_type)
    return df.filter(~eq if negate else eq)


def zero_price(df: DataFrame) -> DataFrame:
    return df.filter(_is("price", 0.0))


def journey(df: DataFrame, key: str, value=None, order: list[str] | None = None) -> DataFrame:
    """Events of one user / session / product (or of all of them) in time
    order; a range-partitioned global sort, so no key lands whole in one
    task."""
    order = order or ["date", "time"]
    if value is not None:
        df = df.filter(F.col(key) == value)
    rest = [c for c in df.columns if c not in [key] + order]
    return df.orderBy(key, *order, *[F.col(c).asc_nulls_first() for c in rest])


def price_history(df: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(product_id, event_time, price) for the given products -- by default
    every product that was ever offered at price 0."""
    if products is None:
        products = zero_price(df).select("product_id").distinct()
    return (df.join(products, "product_id", "left_semi")
              .select("product_id", "event_time", "price")
              .orderBy("product_id", "event_time", "price"))


def invalid_datetime(df: DataFrame) -> DataFrame:
    """Rows whose date + time text does not parse as a timestamp."""
    txt = F.concat_ws(" ", F.col("date").cast("string"), F.col("time"))
    return df.filter(F.col("time").isNotNull() & F.try_to_timestamp(txt, F.lit("yyyy-MM-dd HH:mm:ss")).isNull())


def null_brand_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("brand").isNull())


def blank_brand_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("brand").isNull() | (F.col("brand") == "")).alias("blank_brand_rows"))


def subset_top(df: DataFrame, level: str, value: str, cols: list[str], n: int = 10) -> DataFrame:
    return preview(df.filter(F.col(level) == value).select(*cols), n)


# ------------------------------------------------------------ de-dup
def first_row_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key under ``order`` then the other columns: a struct min
    per key (hash aggregate with map-side combine)."""
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest])
    g = df.groupBy(key).agg(F.min(packed).alias("_r"))
    return g.select(*[F.col(key) if c == key else F.col("_r." + c).alias(c) for c in df.columns])


def distinct_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


# ------------------------------------------------------------ entity counts
def count_distinct_entities(df: DataFrame) -> DataFrame:
    """One row of distinct counts, each a two-level count of its own pruned
    column (no Expand of whole rows)."""
    entities = {"users": "user_id", "products": "product_id", "categories": "category_id",
                "taxonomies": "category_code", "brands": "brand"}
    one = df.sparkSession.range(1)
    return one.select(*[df.select(c).distinct().agg(F.count(c)).scalar().alias(n) for n, c in entities.items()])


def brand_nunique_per_product(df: DataFrame) -> DataFrame:
    """Distinct non-null brands per product (two-level: distinct pairs, then
    count; no Expand)."""
    pairs = df.select("product_id", "brand").distinct()
    return pairs.groupBy("product_id").agg(F.count("brand").alias("n_brands"))


def multi_brand_products(df: DataFrame) -> DataFrame:
    """Products with more than one distinct brand value, null counted as a
    value."""
    pairs = df.select("product_id", "brand").distinct()
    return (pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_brand_values"))
            .filter(F.col("n_brand_values") > 1))


def category_coverage(products: DataFrame) -> DataFrame:
    """Share of products with / without a category code. As in the
    reference, products with a main but no sub category are in neither
    count; they are reported as a third number."""
    a = products.agg(
        F.count_if(F.col("main_category").isNotNull() & F.col("sub_category").isNotNull()).alias("with_code"),
        F.count_if(F.col("main_category").isNull()).alias("without_code"),
        F.count_if(F.col("main_category").isNotNull() & F.col("sub_category").isNull()).alias("main_only"))
    tot = F.col("with_code") + F.col("without_code")
    pct = F.lit(100.0) * safe_div(F.col("with_code"), tot)
    return a.select("*", pct.alias("pct_with_code"),
                    (F.lit(100.0) * safe_div(F.col("without_code"), tot)).alias("pct_without_code"),
                    F.coalesce(pct < 50, F.lit(False)).alias("coverage_warning"))


def distinct_products_per(df: DataFrame, key: str) -> DataFrame:
    """Distinct products per key (distinct pairs then count), descending."""
    pairs = df.filter(F.col(key).isNotNull()).select(key, "product_id").distinct()
    return (pairs.groupBy(key).agg(F.count("product_id").alias("products"))
            .orderBy(F.desc("products"), key))


def topn_plus_other(counts: DataFrame, name: str, value: str, n: int = 10,
                    other: str = "Other") -> DataFrame:
    """First n groups by value (name breaks ties) and one ``other`` row with
    the sum of the rest. The top list is a bounded TakeOrdered of n rows."""
    top = counts.orderBy(F.desc(value), F.asc(name)).limit(n)
    tot = counts.agg(F.sum(value).alias("_all"))
    top_sum = top.agg(F.sum(value).alias("_top"), F.count(F.lit(1)).alias("_n"))
    rest = (with_scalars(tot, top_sum)
            .filter(F.col("_all") - F.coalesce(F.col("_top"), F.lit(0)) > 0)
            .select(F.lit(other).alias(name), (F.col("_all") - F.coalesce(F.col("_top"), F.lit(0))).alias(value)))
    return top.select(name, value).unionByName(rest)


def shared_subcategories(df: DataFrame) -> DataFrame:
    """(sub, main, rows) for sub categories that appear under several main
    categories."""
    g = df.filter(F.col("sub_category").isNotNull() & F.col("main_category").isNotNull()) \
          .groupBy("sub_category", "main_category").agg(F.count(F.lit(1)).alias("count"))
    multi = (g.groupBy("sub_category").agg(F.count(F.lit(1)).alias("_m"))
             .filter(F.col("_m") > 1).select("sub_category"))
    return g.join(multi, "sub_category", "left_semi")


def category_tree_counts(products: DataFrame) -> DataFrame:
    return (products.filter(F.col("main_category").isNotNull() & F.col("sub_category").isNotNull())
            .groupBy("main_category", "sub_category").agg(F.count(F.lit(1)).alias("count")))


def inconsistent_category(products: DataFrame) -> DataFrame:
    """category_ids whose products carry more than one sub category value
    (a missing value counts as one)."""
    pairs = products.select("category_id", "sub_category").distinct()
    return (pairs.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_codes"))
            .filter(F.col("n_codes") > 1))


# ------------------------------------------------------------ prices
def zero_price_stats(df: DataFrame) -> DataFrame:
    """Zero-price products, % of them without brand, % of all products,
    % of all products without brand. Distinct (product, flags) first, then
    one small aggregate."""
    p = df.groupBy("product_id").agg(
        F.bool_or(_is("price", 0.0)).alias("z"),
        F.bool_or(_is("price", 0.0) & F.col("brand").isNull()).alias("zn"),
        F.bool_or(F.col("brand").isNull()).alias("n"))
    a = p.agg(F.count_if("z").alias("zero_price_products"), F.count_if("zn").alias("_zn"),
              F.count_if("n").alias("_n"), F.count(F.lit(1)).alias("_all"))
    return a.select(
        "zero_price_products",
        (F.lit(100.0) * safe_div(F.col("_zn"), F.col("zero_price_products"))).alias("pct_zero_no_brand"),
        (F.lit(100.0) * safe_div(F.col("zero_price_products"), F.col("_all"))).alias("pct_zero_of_all"),
        (F.lit(100.0) * safe_div(F.col("_n"), F.col("_all"))).alias("pct_no_brand_of_all"))


def percent_align(num: DataFrame, den: DataFrame, key: str, num_col: str, den_col: str,
                  out: str = "percentage") -> DataFrame:
    """Index-aligned division of two grouped series: full outer join on the
    key, 100 * num / den (null where either side is missing)."""
    j = num.join(den, key, "full_outer")
    return j.select(key, num_col, den_col, (F.lit(100.0) * safe_div(F.col(num_col), F.col(den_col))).alias(out))


def zero_price_by_main(df: DataFrame) -> DataFrame:
    z = (zero_price(df).filter(F.col("main_category").isNotNull())
         .select("main_category", "product_id").distinct()
         .groupBy("main_category").agg(F.count(F.lit(1)).alias("zero_price_products")))
    a = distinct_products_per(df, "main_category")
    return percent_align(z, a, "main_category", "zero_price_products", "products")


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def always_zero_price(df: DataFrame) -> DataFrame:
    return (df.groupBy("product_id").agg(F.avg("price").alias("mean_price"))
            .filter(F.col("mean_price") == 0).select("product_id"))


def median_price_by_brand(df: DataFrame) -> DataFrame:
    brands = df.filter(F.col("brand").isNotNull()).select("brand").distinct()
    return brands.join(exact_quantiles(df, "brand", "price", {"median_price": 0.5}), "brand", "left")


def price_range_counts(prices: DataFrame, col: str = "price") -> DataFrame:
    r = prices.select(price_range(col).alias("price_range")).filter(F.col("price_range").isNotNull())
    return r.groupBy("price_range").agg(F.count(F.lit(1)).alias("count"))


def price_histogram(prices: DataFrame, bins: int = 50, col: str = "price") -> DataFrame:
    """Equal-width histogram between min and max (last bin closed), all bins
    listed including empty ones."""
    x = prices.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    mm = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width).cast("int"), F.lit(bins - 1)))
    counts = with_scalars(x, mm).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = mm.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    g = grid.join(counts, "bin", "left")
    return g.select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count"))


# ------------------------------------------------------------ behaviour
def _grand_totals(g: DataFrame, cols: list[str]) -> DataFrame:
    """``g`` plus ``_t_<col>`` = the column's sum over all rows of ``g``.

    For grouped results keyed by a low-cardinality key (event type, hour,
    weekday): a window over the grouped rows is one small partition of at
    most that many rows, where a scalar subquery would read the events a
    second time."""
    everything = Window.partitionBy()
    return g.select("*", *[F.sum(c).over(everything).alias("_t_" + c) for c in cols])


def event_mix(df: DataFrame) -> DataFrame:
    g = count_by(df, "event_type")
    return _grand_totals(g, ["count"]).withColumnRenamed("_t_count", "_t").select("event_type", "count", safe_div(F.col("count"), F.col("_t")).alias("share"))


def events_by(df: DataFrame, key_expr, key: str, types=("view", "cart", "purchase")) -> DataFrame:
    """Counts per key for each event type, and each count's share of its
    type's total; ``key_expr`` is a low-cardinality key (hour, weekday)."""
    g = df.groupBy(key_expr.alias(key)).agg(*[F.count_if(_is("event_type", t)).alias(t) for t in types])
    return _grand_totals(g, list(types)).select(
        key, *types, *[safe_div(F.col(t), F.col("_t_" + t)).alias(t + "_percent") for t in types])


def hour_of_time(time_col: str = "time"):
    return F.substring(F.col(time_col), 1, 2).cast("int")


def top_groups(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(key)).limit(n)


def purchases(df: DataFrame) -> DataFrame:
    return filter_event_type(df, "purchase")


def top_sellers(df: DataFrame, n: int = 20) -> DataFrame:
    g = count_by(purchases(df).filter(F.col("brand").isNotNull()), "brand", name="purchases")
    return top_groups(g, "brand", "purchases", n)


def brand_word_freq(df: DataFrame) -> DataFrame:
    w = (purchases(df).filter(F.col("brand").isNotNull())
         .select(F.explode(F.split(F.col("brand"), " ")).alias("word")).filter(F.length("word") > 0))
    return count_by(w, "word", name="freq")


def top_categories(df: DataFrame) -> DataFrame:
    """Purchases per category_id with the main / sub category of its first
    purchase row."""
    p = purchases(df)
    first = F.struct("date", "time", "product_id", "user_id", "price")
    g = p.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by(F.struct("main_category", "sub_category"), first).alias("_c"))
    return g.select("category_id", F.col("_c.main_category").alias("main_category"),
                    F.col("_c.sub_category").alias("sub_category"), "count")


def orders_by_category_brand(df: DataFrame) -> DataFrame:
    keys = ["category_id", "main_category", "sub_category", "brand"]
    p = purchases(df).dropna(subset=keys)
    return count_by(p, *keys, name="orders")


def market_share(df: DataFrame, level: str, value: str, n: int = 10) -> DataFrame:
    """Purchases per brand within one category, top n + 'Others'."""
    o = orders_by_category_brand(df).filter(F.col(level) == value)
    g = o.groupBy("brand").agg(F.sum("orders").alias("orders"))
    return topn_plus_other(g, "brand", "orders", n, "Others")


def orders_per_weekday_top_brands(df: DataFrame, n: int = 10) -> DataFrame:
    o = count_by(purchases(df).filter(F.col("brand").isNotNull()), "weekday", "brand", name="orders")
    tot = o.groupBy("brand").agg(F.sum("orders").alias("_t"))
    top = F.broadcast(top_groups(tot, "brand", "_t", n).select("brand"))
    return o.join(top, "brand", "left_semi").select(
        weekday_name("weekday").alias("weekday"), "brand", "orders")


def revenue_by_brand(df: DataFrame, purchases_only: bool = False) -> DataFrame:
    """Price sum per brand. The reference sums every event (views too);
    ``purchases_only`` gives the sales revenue."""
    src = purchases(df) if purchases_only else df
    return src.filter(F.col("brand").isNotNull()).groupBy("brand").agg(F.sum("price").alias("monthly_revenue"))


def daily_revenue_top(df: DataFrame, n: int = 5, purchases_only: bool = False) -> DataFrame:
    src = purchases(df) if purchases_only else df
    d = src.filter(F.col("brand").isNotNull()).groupBy("date", "brand").agg(F.sum("price").alias("daily_revenue"))
    tot = d.groupBy("brand").agg(F.sum("daily_revenue").alias("_t"))
    top = F.broadcast(top_groups(tot, "brand", "_t", n).select("brand"))
    return d.join(top, "brand", "left_semi")


def avg_price_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("price").alias("product_avg_price"))


PRODUCT_BRAND_KEYS = ["product_id", "category_id", "main_category", "sub_category", "brand"]


def brands_per_product_rows(df: DataFrame) -> DataFrame:
    """Rows of the (product, category, brand) average-price table with the
    number of such rows of their product (COUNT(*) OVER (PARTITION BY
    product_id)); the window runs over aggregated rows only."""
    from pyspark.sql import Window
    g = avg_price_by(df, PRODUCT_BRAND_KEYS)
    return g.withColumn("number_brands", F.count(F.lit(1)).over(Window.partitionBy("product_id")))


def multi_brand_count(df: DataFrame) -> DataFrame:
    return brands_per_product_rows(df).agg(F.count_if(F.col("number_brands") == 2).alias("rows_with_two_brands"))


def product_funnel(df: DataFrame) -> DataFrame:
    """Average price, views, carts, purchases and purchases / carts (the
    reference names it abandonment_rate; it is a cart conversion)."""
    g = df.filter(F.col("user_session").isNotNull()).groupBy(*PRODUCT_BRAND_KEYS).agg(
        F.avg("price").alias("product_avg_price"),
        F.count_if(_is("event_type", "view")).alias("product_total_views"),
        F.count_if(_is("event_type", "cart")).alias("product_total_carts"),
        F.count_if(_is("event_type", "purchase")).alias("product_total_purchases"))
    conv = F.when(F.col("product_total_carts") > 0,
                  F.col("product_total_purchases") / F.col("product_total_carts")).otherwise(F.lit(0.0))
    return g.withColumn("cart_conversion", conv)


def semi_join_session(df: DataFrame) -> DataFrame:
    """``user_session IN (SELECT DISTINCT user_session FROM same table)``:
    keeps exactly the rows with a session, so it is written as that filter
    instead of a self semi-join (no shuffle of the whole table)."""
    return df.filter(F.col("user_session").isNotNull())


def level_event_counts(df: DataFrame, level: str, value: str) -> DataFrame:
    return (df.filter(F.col(level) == value)
            .groupBy("product_id", level, "event_type").agg(F.count("event_type").alias("event_count")))


def max_event_products(df: DataFrame, level: str, value: str) -> DataFrame:
    """(product, level, event type) counts ranked within the level; rank 1
    rows (ties kept). The window partitions aggregated rows."""
    from pyspark.sql import Window
    c = level_event_counts(df, level, value)
    w = Window.partitionBy(level).orderBy(F.desc("event_count"))
    return c.withColumn("rk", F.rank().over(w)).filter(F.col("rk") == 1).drop("rk")


def popularity_score(df: DataFrame, level: str, value: str) -> DataFrame:
    """(0.2 views + 0.3 events other than cart / purchase + 0.5 purchases)
    / the rank-1 event count, for the products holding the rank-1 count."""
    m = max_event_products(df, level, value).select("product_id", level, "event_count")
    j = df.filter(F.col(level) == value).join(m, ["product_id", level], "inner")
    keys = ["product_id", "category_id", "main_category", "sub_category", "brand", "event_count"]
    g = j.groupBy(*keys).agg(
        F.avg("price").alias("product_avg_price"),
        F.count_if(_is("event_type", "view")).alias("product_total_views"),
        F.count_if(_is("event_type", "cart")).alias("product_total_carts"),
        F.count_if(_is("event_type", "purchase")).alias("product_total_purchases"),
        F.count_if(~F.col("event_type").isin("cart", "purchase")).alias("_other"))
    score = (F.lit(0.2) * F.col("product_total_views") + F.lit(0.3) * F.col("_other")
             + F.lit(0.5) * F.col("product_total_purchases")) / F.col("event_count")
    return g.withColumn("popularity_score", score).drop("_other")


def regression_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    e = F.col(pred).cast("double") - F.col(truth).cast("double")
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                  F.sqrt(F.avg(e * e)).alias("rmse"))


def standard_scale(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """z-score with the population standard deviation (1-row stats)."""
    st = df.agg(*[F.avg(c).alias("_m_" + c) for c in cols],
                *[F.stddev_pop(c).alias("_s_" + c) for c in cols])
    j = with_scalars(df, st)
    return j.select(key, *[safe_div(F.col(c) - F.col("_m_" + c), F.col("_s_" + c)).alias(c) for c in cols])
