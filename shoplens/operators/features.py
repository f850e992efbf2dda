"""Feature engineering on clean events (M2 -> M3..M7).

Global scalars (totals, minima, maxima, the last date) are 1-row aggregates
attached as scalar subqueries; no window without PARTITION BY ever pulls a
whole column into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.columns import clamp, half_life_coef, rate_or_count, safe_div
from shoplens.operators.clean import EVENT_TYPES
from shoplens.operators.quantiles import exact_quantiles

RATE_COLUMNS = ["cart_per_view", "purchase_per_view", "remove_per_cart", "purchase_per_cart"]
COUNT_COLUMNS = ["views", "carts", "remove_from_carts", "purchases"]
# Default interaction weights and half-life.
DEFAULT_WEIGHTS = {"view": 0.1, "cart": 0.4, "remove_from_cart": -0.3, "purchase": 1.0}
DEFAULT_RECENCY_DAYS = 15
DEFAULT_WEIGHT_DECAY = 0.5


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` plus every column of the one-row global aggregate ``row``, each
    as a scalar subquery: evaluated once and inlined as a value in the
    generated code -- no join. Scalar subqueries over the same aggregate are
    merged by the optimizer into one job."""
    return df.select("*", *[row.select(c).scalar().alias(c) for c in row.columns])


def category_price_quartiles(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q1, median, Q3 (linear interpolation) and IQR of price per
    category_id; categories without a price have nulls. ``approx`` takes a
    bounded-memory sketch instead of the exact ranks."""
    d = df.filter(F.col("category_id").isNotNull())
    if approx:
        q = d.groupBy("category_id").agg(F.percentile_approx("price", [0.25, 0.5, 0.75], 10000).alias("_q")).select(
            "category_id", *[F.col("_q")[i].alias(n) for i, n in enumerate(("Q1", "median", "Q3"))])
    else:
        q = d.select("category_id").distinct().join(
            exact_quantiles(d, "category_id", "price", {"Q1": 0.25, "median": 0.5, "Q3": 0.75}), "category_id", "left")
    return q.withColumn("IQR", F.col("Q3") - F.col("Q1"))


def relative_price(df: DataFrame, approx: bool = False) -> DataFrame:
    """(price - category median) / IQR, 0 when IQR = 0, clamped to [-10, 10].
    The quartile table has one row per category; AQE broadcasts it."""
    q = category_price_quartiles(df, approx)
    j = df.join(q, "category_id", "left")
    rel = F.when(F.col("IQR") == 0, F.lit(0.0)).otherwise(
        clamp((F.col("price") - F.col("median")) / F.col("IQR"), -10, 10))
    cols = []
    for c in df.columns:
        cols.append(F.col(c))
        if c == "price":
            cols.append(rel.alias("relative_price"))
    return j.select(*cols)


def _rates(df: DataFrame) -> DataFrame:
    return (df.withColumn("cart_per_view", rate_or_count("carts", "views"))
              .withColumn("purchase_per_view", rate_or_count("purchases", "views"))
              .withColumn("remove_per_cart", rate_or_count("remove_from_carts", "carts"))
              .withColumn("purchase_per_cart", rate_or_count("purchases", "carts")))


def _weight_and_normalise(df: DataFrame, lead: list[str]) -> DataFrame:
    """Rates x (views or carts share of the total), nulls -> 0, then min-max
    per rate column (null where the column is constant).

    ``df`` (one row per user or product) is written once first: the totals
    and the min/max are scalar subqueries over it, and would otherwise each
    re-aggregate the raw events."""
    from shoplens.session import materialize
    df = materialize(df, "rates")
    w = with_scalars(df, df.agg(F.sum("views").alias("_tv"), F.sum("carts").alias("_tc")))
    view_share = safe_div(F.col("views"), F.col("_tv"))
    cart_share = safe_div(F.col("carts"), F.col("_tc"))
    share = {"cart_per_view": view_share, "purchase_per_view": view_share,
             "remove_per_cart": cart_share, "purchase_per_cart": cart_share}
    w = w.select(*[F.coalesce(F.col(c) * share[c], F.lit(0.0)).alias(c) if c in RATE_COLUMNS
                   else F.col(c) for c in df.columns])
    return min_max_normalise(w, RATE_COLUMNS)


def min_max_normalise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) of each of ``cols``; null where the column is
    constant. The other columns pass through."""
    mm = df.agg(*[F.min(c).alias("_mn_" + c) for c in cols], *[F.max(c).alias("_mx_" + c) for c in cols])
    n = with_scalars(df, mm)
    return n.select(*[safe_div(F.col(c) - F.col("_mn_" + c), F.col("_mx_" + c) - F.col("_mn_" + c)).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def _count_if(t: str):
    return F.count_if(F.coalesce(F.col("event_type") == t, F.lit(False)))


def event_order() -> Column:
    """(date, time ``HH:mm:ss``) as one long with the struct's order (nulls
    first): a fixed-width ordering keeps ``min_by`` in a hash aggregate,
    where a struct ordering forces a sort of every event by key."""
    d = F.coalesce(F.unix_date("date").cast("long") + F.lit(1_000_000), F.lit(0))
    hms = (F.substring("time", 1, 2).cast("long") * 3600 + F.substring("time", 4, 2).cast("long") * 60
           + F.substring("time", 7, 2).cast("long"))
    return d * F.lit(86_401) + F.coalesce(hms + F.lit(1), F.lit(0))


def product_table(df: DataFrame) -> DataFrame:
    """One row per product (M4): first/last date, first category_id, average
    price and relative price, event counts and the four weighted, min-max
    normalised rates. One hash aggregate over the events."""
    if "relative_price" not in df.columns:
        df = relative_price(df)
    g = df.groupBy("product_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("category_id", F.when(F.col("category_id").isNotNull(), event_order())).alias("category_id"),
        F.avg("price").alias("avg_price"), F.avg("relative_price").alias("relative_price"),
        *[_count_if(t).alias(n) for t, n in zip(EVENT_TYPES, COUNT_COLUMNS)])
    return _weight_and_normalise(_rates(g), ["product_id"])


def user_interaction(df: DataFrame, strict: bool = False, dates: bool = False) -> DataFrame:
    """Per user: event counts, average (relative) price of views and carts,
    distinct products per event type.

    Two-level aggregation instead of distinct-count aggregates: first by
    (user, event_type, product) -- collapses repeats map-side and spreads a
    hot user over many keys -- then by user over at most one row per
    (type, product). ``strict`` gives users without any view zeros
    everywhere; ``dates`` adds the first and last date.
    """
    if "relative_price" not in df.columns:
        df = relative_price(df)
    l1 = df.groupBy("user_id", "event_type", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("sp"), F.count("price").alias("cp"),
        F.sum("relative_price").alias("sr"), F.count("relative_price").alias("cr"),
        F.min("date").alias("d0"), F.max("date").alias("d1"))

    def f(t):
        return F.coalesce(F.col("event_type") == t, F.lit(False))

    def avg_of(s, c, t):
        return safe_div(F.sum(F.when(f(t), F.col(s))), F.sum(F.when(f(t), F.col(c))))

    g = l1.groupBy("user_id").agg(
        *([F.min("d0").alias("first_date"), F.max("d1").alias("last_date")] if dates else []),
        *[F.coalesce(F.sum(F.when(f(t), F.col("n"))), F.lit(0)).alias(n)
          for t, n in zip(EVENT_TYPES, COUNT_COLUMNS)],
        F.coalesce(avg_of("sp", "cp", "view"), F.lit(0.0)).alias("avg_view_price"),
        F.coalesce(avg_of("sp", "cp", "cart"), F.lit(0.0)).alias("avg_purchase_price"),
        F.coalesce(avg_of("sr", "cr", "view"), F.lit(0.0)).alias("avg_view_relative_price"),
        F.coalesce(avg_of("sr", "cr", "cart"), F.lit(0.0)).alias("avg_purchase_relative_price"),
        *[F.count_if(f(t) & F.col("product_id").isNotNull()).alias(n) for t, n in zip(
            EVENT_TYPES, ["distinct_view_product", "distinct_cart_product",
                          "distinct_remove_product", "distinct_purchase_product"])])
    if strict:
        has_view = F.col("views") > 0
        g = g.select(*[F.col(c) if c in ("user_id", "first_date", "last_date") else
                       F.when(has_view, F.col(c)).otherwise(F.lit(0).cast(g.schema[c].dataType)).alias(c)
                       for c in g.columns])
    return g


USER_COLUMNS = (["user_id", "first_date", "last_date"] + COUNT_COLUMNS +
                ["avg_view_price", "avg_purchase_price", "avg_view_relative_price",
                 "avg_purchase_relative_price", "distinct_view_product", "distinct_cart_product",
                 "distinct_remove_product", "distinct_purchase_product"] + RATE_COLUMNS)


def user_table(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row per user (M5): dates, interaction features and the four
    weighted, min-max normalised rates."""
    u = _weight_and_normalise(_rates(user_interaction(df, strict, dates=True)), ["user_id"])
    return u.select(*USER_COLUMNS)


#: Types of the stored user table.
USER_TYPES = {"user_id": "bigint", "first_date": "date", "last_date": "date",
              **{c: "int" for c in COUNT_COLUMNS + ["distinct_view_product", "distinct_cart_product",
                                                    "distinct_remove_product", "distinct_purchase_product"]},
              **{c: "double" for c in ["avg_view_price", "avg_purchase_price", "avg_view_relative_price",
                                       "avg_purchase_relative_price"] + RATE_COLUMNS}}


def cast_user_table(df: DataFrame) -> DataFrame:
    """The user table with its stored types; a count beyond them is an error."""
    return df.select(*[F.col(c).cast(USER_TYPES[c]).alias(c) if c in USER_TYPES else F.col(c) for c in df.columns])


def recency(df: DataFrame, recency_days: float = DEFAULT_RECENCY_DAYS,
            weight_decay: float = DEFAULT_WEIGHT_DECAY) -> DataFrame:
    """Days before the last date of the data set and the half-life weight."""
    r = with_scalars(df, df.agg(F.max("date").alias("_last"))).withColumn("recency", F.datediff("_last", "date"))
    return (r.withColumn("recency_coef", half_life_coef("recency", weight_decay, recency_days))
             .drop("_last"))


def interaction_table(df: DataFrame, recency_days: float = DEFAULT_RECENCY_DAYS,
                      weight_decay: float = DEFAULT_WEIGHT_DECAY,
                      weights: dict[str, float] | None = None) -> DataFrame:
    """Recency-weighted interaction score per (user, product) clamped to
    [0, 100] (M6). One hash aggregate on the pair key."""
    weights = weights or DEFAULT_WEIGHTS
    r = recency(df, recency_days, weight_decay)
    wexpr = None
    for t, wt in weights.items():
        wexpr = (F.when(F.col("event_type") == t, F.lit(float(wt))) if wexpr is None
                 else wexpr.when(F.col("event_type") == t, F.lit(float(wt))))
    wexpr = wexpr.otherwise(F.lit(0.0))
    s = r.groupBy("user_id", "product_id").agg(F.sum(wexpr * F.col("recency_coef")).alias("_s"))
    return s.select("user_id", "product_id",
                    F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(100.0)).alias("interaction_score"))


def left_join_chain(frames: list[DataFrame], on: list[str], suffixes: list[tuple[str, str]]) -> DataFrame:
    """Fold of equi left joins: frame i + 1 is joined on ``on[i]``; names that
    both sides have beside the key get ``suffixes[i]`` (left, right)."""
    out = frames[0]
    for right, key, (ls, rs) in zip(frames[1:], on, suffixes, strict=True):
        clash = (set(out.columns) & set(right.columns)) - {key}
        left = out.select(*[F.col(c).alias(c + ls) if c in clash else F.col(c) for c in out.columns])
        right = right.select(*[F.col(c).alias(c + rs) if c in clash else F.col(c) for c in right.columns])
        out = left.join(right, key, "left").select(*left.columns, *[c for c in right.columns if c != key])
    return out


def train_table(interaction: DataFrame, user: DataFrame, product: DataFrame) -> DataFrame:
    """interaction LEFT JOIN user LEFT JOIN product (M7); clashing names get
    ``_user`` / ``_product`` and the first/last dates are dropped."""
    dates = ["first_date", "last_date"]
    return left_join_chain([interaction, user.drop(*dates), product.drop(*dates)], ["user_id", "product_id"],
                           [("", "_user"), ("_user", "_product")])
