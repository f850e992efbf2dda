"""Explicit schemas for every file source: no inference pass, stable types."""

from pyspark.sql import types as T

# Raw shop event as exported monthly (one CSV per month).
RAW_EVENT_CSV = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
])

# Raw shop event with a typed event_time (M1).
RAW_EVENT = T.StructType([
    T.StructField("event_time", T.TimestampNTZType()),
    *RAW_EVENT_CSV.fields[1:],
])

# Raw catalogue row (M8): every measure is a dirty string.
RAW_CATALOG = T.StructType([T.StructField(c, T.StringType()) for c in (
    "product_id", "product_name", "about_product", "category", "discounted_price",
    "actual_price", "discount_percentage", "rating", "rating_count", "user_id",
    "user_name", "img_link", "product_link")])

# Pre-computed sentiment scores joined onto the catalogue.
SENTIMENT = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("neg", T.DoubleType()),
    T.StructField("neu", T.DoubleType()),
    T.StructField("pos", T.DoubleType()),
    T.StructField("compound", T.DoubleType()),
])

# Search catalogue row: catalogue columns + cleaned description.
SEARCH_QUERY = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("text", T.StringType()),
])
