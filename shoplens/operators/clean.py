"""Cleaning of raw shop events (M1 -> M2).

All de-duplication is expressed as aggregation, not as sort-based windows:
Spark's partial (map-side) aggregation collapses repeated keys before the
shuffle, so a hot product, user or session that holds a large share of the
rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.columns import split_first, split_rest, time_of_day, weekday_mon0

# The event vocabulary and the raw / clean column orders.
EVENT_TYPES = ["view", "cart", "remove_from_cart", "purchase"]
RAW_COLUMNS = ["event_time", "event_type", "product_id", "category_id", "category_code",
               "brand", "price", "user_id", "user_session"]
SPLIT_COLUMNS = ["event_time", "event_type", "product_id", "category_id", "main_category",
                 "sub_category", "brand", "price", "user_id", "user_session"]
CLEAN_COLUMNS = ["date", "weekday", "time", "event_type", "product_id", "category_id",
                 "main_category", "sub_category", "brand", "price", "user_id", "user_session"]
SESSION_KEY = ["product_id", "user_id", "user_session"]


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct (null equals null). Hash aggregate with map-side
    combine: duplicates collapse before they are shuffled."""
    return df.dropDuplicates()


def find_duplicates(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, all members (``keep=False``),
    with the multiplicity. Copies are equal in every column, so each counted
    group is written out again as often as it was counted."""
    cols = df.columns
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_copies"))
            .filter(F.col("n_copies") > 1)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).drop("_copy"))


def negative_price(df: DataFrame) -> Column:
    return F.coalesce(F.col("price") < 0, F.lit(False))


def drop_neg_price(df: DataFrame) -> DataFrame:
    """Keep rows whose price is not negative; a missing price is kept."""
    return df.filter(~negative_price(df))


def check_neg_price(df: DataFrame) -> DataFrame:
    return df.filter(negative_price(df))


def split_category_code(df: DataFrame, col: str = "category_code") -> DataFrame:
    """``a.b.c`` -> main_category ``a``, sub_category ``b.c`` (split at the
    first dot; no dot -> sub is null)."""
    out = df.withColumn("main_category", split_first(col, r"[.]")) \
            .withColumn("sub_category", split_rest(col, r"[.]"))
    cols = [c for c in SPLIT_COLUMNS if c in out.columns]
    rest = [c for c in out.columns if c not in cols and c != col]
    return out.select(*cols, *rest)


def usable_brand(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (F.lower(c) != "nan")


def canonical_brand_first(df: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """First usable brand (not null, '' or 'nan') of every product, by event
    order; ties broken by the brand itself. One row per product_id."""
    order_cols = order_cols or (["event_time"] if "event_time" in df.columns else ["date", "time"])
    ordering = F.struct(*[F.col(c) for c in order_cols], F.col("brand"))
    return (df.filter(usable_brand(F.col("brand")))
              .groupBy("product_id")
              .agg(F.min_by("brand", ordering).alias("canonical_brand")))


def canonical_brand_max(df: DataFrame) -> DataFrame:
    """Warehouse rule: the largest non-null brand of a product, else null."""
    return df.groupBy("product_id").agg(F.max("brand").alias("brand"))


def fill_brand(df: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Overwrite each row's brand with its product's canonical brand; rows of
    products without a usable brand keep their own value. The canonical
    table has one row per product; AQE broadcasts it when it is measured
    small and otherwise shuffle-joins (skewed partitions are split)."""
    canonical = canonical if canonical is not None else canonical_brand_first(df)
    cols = df.columns
    j = df.join(canonical, "product_id", "left")
    return j.select(*[F.coalesce("canonical_brand", "brand").alias("brand") if c == "brand"
                      else F.col(c) for c in cols])


def dedup_session_events(df: DataFrame, event_types, keep="first",
                         order_cols: list[str] | None = None) -> DataFrame:
    """Keep one row per (event_type, product_id, user_id, user_session) for
    each of ``event_types``: the first (or last) by time, remaining columns
    as tie-break. Rows of other event types pass through untouched.
    ``keep`` is one value or a dict per event type.

    Written as a min/max of a struct per key in a single aggregate for all
    the listed types: map-side combine, no global sort, no per-key row
    buffering, one scan of the input.
    """
    types = [event_types] if isinstance(event_types, str) else list(event_types)
    keeps = keep if isinstance(keep, dict) else {t: keep for t in types}
    if any(k not in ("first", "last") for k in keeps.values()):
        raise ValueError("keep must be 'first' or 'last'")
    cols = df.columns
    order_cols = order_cols or (["event_time"] if "event_time" in cols else ["date", "time"])
    rest = [c for c in cols if c not in SESSION_KEY and c not in order_cols and c != "event_type"]
    packed = F.struct(*[F.col(c) for c in order_cols + rest])
    is_t = F.coalesce(F.col("event_type").isin(*types), F.lit(False))
    keys = ["event_type"] + SESSION_KEY
    firsts = [t for t in types if keeps[t] == "first"]
    lasts = [t for t in types if keeps[t] == "last"]
    aggs = []
    if firsts:
        aggs.append(F.min(F.when(F.col("event_type").isin(*firsts), packed)).alias("_f"))
    if lasts:
        aggs.append(F.max(F.when(F.col("event_type").isin(*lasts), packed)).alias("_l"))
    g = df.filter(is_t).groupBy(*keys).agg(*aggs)
    pick = (F.col("_f") if not lasts else F.col("_l") if not firsts
            else F.coalesce(F.col("_f"), F.col("_l")))
    chosen = g.withColumn("_r", pick).select(
        *[F.col(c) if c in keys else F.col("_r." + c).alias(c) for c in cols])
    return df.filter(~is_t).unionByName(chosen)


def drop_cart_duplicates(df: DataFrame) -> DataFrame:
    return dedup_session_events(df, "cart", "first")


def drop_remove_cart_duplicates(df: DataFrame, keep: str = "first") -> DataFrame:
    return dedup_session_events(df, "remove_from_cart", keep)


def drop_session_duplicates(df: DataFrame, remove_keep: str = "first") -> DataFrame:
    """Both session de-duplications (remove_from_cart, then cart) in one
    aggregate: they touch disjoint rows, so the order does not matter."""
    return dedup_session_events(df, ["remove_from_cart", "cart"],
                                {"remove_from_cart": remove_keep, "cart": "first"})


def drop_row_and_session_duplicates(df: DataFrame, remove_keep: str = "first") -> DataFrame:
    """``drop_duplicates`` and both session de-duplications in one aggregate:
    cart and remove_from_cart rows are grouped by their session key and keep
    one row, all other rows are grouped by their whole content."""
    if remove_keep not in ("first", "last"):
        raise ValueError("remove_keep must be 'first' or 'last'")
    cols = df.columns
    keys = ["event_type"] + SESSION_KEY
    packed = F.struct("event_time", *[F.col(c) for c in cols if c not in keys + ["event_time"]])
    session = F.coalesce(F.col("event_type").isin("cart", "remove_from_cart"), F.lit(False))
    g = df.groupBy(*keys, F.when(~session, packed).alias("_whole")).agg(
        F.min(F.when(session, packed)).alias("_first"),
        *([F.max(F.when(session, packed)).alias("_last")] if remove_keep == "last" else []))
    row = F.coalesce("_whole", *([F.when(F.col("event_type") == "remove_from_cart", F.col("_last"))]
                                 if remove_keep == "last" else []), "_first")
    return g.withColumn("_r", row).select(*[F.col(c) if c in keys else F.col("_r." + c).alias(c) for c in cols])


def split_datetime(df: DataFrame) -> DataFrame:
    """event_time -> date, weekday (Monday = 0), time ``HH:mm:ss``; the
    clean column order."""
    out = (df.withColumn("date", F.to_date("event_time"))
             .withColumn("weekday", weekday_mon0(F.to_date("event_time")))
             .withColumn("time", time_of_day("event_time")))
    return out.select(*[c for c in CLEAN_COLUMNS if c in out.columns])


def clean_events(raw: DataFrame, remove_keep: str = "first") -> DataFrame:
    """The whole cleaning chain M1 -> M2: distinct rows, no negative prices,
    category split, canonical brand, one cart / remove_from_cart per session
    and product, date / weekday / time.

    Repeated rows change neither the canonical brands nor which row of a
    session is first, so the rows are de-duplicated once, at the end."""
    df = split_category_code(drop_neg_price(raw.select(*RAW_COLUMNS)))
    df = drop_row_and_session_duplicates(fill_brand(df), remove_keep)
    return split_datetime(df)
