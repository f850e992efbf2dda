"""Golden cases from the reference's inline demos and comments."""

import datetime as dt
import math

from pyspark.sql import functions as F

from shoplens.functions.columns import camel_split, half_life_coef, number_taker, price_range, rating_category
from shoplens.functions.text import text_clean
from shoplens.operators import clean as C
from shoplens.operators.recommend import routing_tier


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_number_taker(spark):
    assert _one(spark, number_taker("x"), "$334,2.99") == 3342.99
    assert _one(spark, number_taker("x"), "|") is None
    assert _one(spark, number_taker("x"), "₹1,099.50") == 1099.5


def test_camel_split(spark):
    assert _one(spark, camel_split("x"), "Computers&Accessories") == " Computers & Accessories"


def test_text_clean(spark):
    s = "She'd like to drink 1 coffee, OMG|🎁【sas (2.3 samsung)!!... 🔥🔥"
    assert _one(spark, text_clean("x"), s) == "she would like to drink coffee omg sas samsung"
    # words glued to non-ASCII letters are dropped, other scripts split words
    assert _one(spark, text_clean("x"), "café abc€def naïve") == "abc def"


def test_half_life(spark):
    df = spark.createDataFrame([(0,), (15,), (30,)], "d int")
    got = [r[0] for r in df.select(half_life_coef("d", 0.5, 15)).orderBy(F.col("d")).collect()]
    assert [round(x, 12) for x in got] == [1.0, 0.5, 0.25]


def test_price_ranges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 10, 100, 500, 501)], "p double")
    got = [r[0] for r in df.select(price_range("p")).collect()]
    assert got == [None, "0-10 USD", "10-100 USD", "100-500 USD", "Above 500 USD"]


def test_rating_category(spark):
    df = spark.createDataFrame([(x,) for x in (1.9, 2.0, 3.9, 4.0, 5.0, 5.1)], "r double")
    got = [r[0] for r in df.select(rating_category("r")).collect()]
    assert got == ["Poor", "Below Average", "Average", "Above Average", "Excellent", None]


def test_routing_tiers(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 99, 100)], "n int")
    got = [r[0] for r in df.select(routing_tier(F.col("n"))).collect()]
    assert got == ["new", "mixed-80/20", "mixed-80/20", "20/80"]


def test_brand_fill(spark):
    ids = [5773203, 5773353, 5881589, 5773353, 5723490, 5881449, 5857269, 5773203]
    brands = ["a", None, "c", "b", "d", "d", "nan", "g"]
    t0 = dt.datetime(2019, 10, 1)
    rows = [(t0 + dt.timedelta(minutes=i), p, b) for i, (p, b) in enumerate(zip(ids, brands))]
    df = spark.createDataFrame(rows, "event_time timestamp_ntz, product_id long, brand string")
    got = {(r.product_id, r.brand) for r in C.fill_brand(df).collect()}
    assert got == {(5773203, "a"), (5773353, "b"), (5881589, "c"), (5723490, "d"), (5881449, "d"),
                   (5857269, "nan")}


def test_brand_by_max(spark):
    rows = [(1, None), (2, None), (2, "hama"), (3, None), (3, "jeep"), (3, "jeepwrangler")]
    df = spark.createDataFrame(rows, "product_id long, brand string")
    got = {r.product_id: r.brand for r in C.canonical_brand_max(df).collect()}
    assert got == {1: None, 2: "hama", 3: "jeepwrangler"}


def test_split_category_code(spark):
    df = spark.createDataFrame([("a.b.c",), ("a",), (None,), ("",)], "category_code string")
    got = [(r.main_category, r.sub_category) for r in C.split_category_code(df).collect()]
    assert got == [("a", "b.c"), ("a", None), (None, None), ("", None)]


def test_session_dedup_keeps_first_and_last(spark):
    t = [dt.datetime(2019, 10, 1, 0, i) for i in range(4)]
    rows = [(t[0], "cart", 1, 1, "s", 1.0), (t[1], "cart", 1, 1, "s", 2.0),
            (t[2], "remove_from_cart", 1, 1, "s", 3.0), (t[3], "remove_from_cart", 1, 1, "s", 4.0),
            (t[3], "view", 1, 1, "s", 5.0), (t[3], "view", 1, 1, "s", 5.0)]
    df = spark.createDataFrame(rows, "event_time timestamp_ntz, event_type string, product_id long, "
                                     "user_id long, user_session string, price double")
    first = sorted(r.price for r in C.drop_session_duplicates(df, "first").collect())
    last = sorted(r.price for r in C.drop_session_duplicates(df, "last").collect())
    assert first == [1.0, 3.0, 5.0, 5.0]
    assert last == [1.0, 4.0, 5.0, 5.0]


def test_relative_price_clamp_and_zero_iqr(spark):
    from shoplens.operators.features import relative_price
    rows = [(1, 1.0), (1, 2.0), (1, 3.0), (1, 1000.0), (2, 5.0), (2, 5.0), (3, None)]
    df = spark.createDataFrame(rows, "category_id long, price double")
    got = sorted((r.category_id, r.price, r.relative_price) for r in relative_price(df).collect()
                 if r.price is not None)
    # category 1: Q1 = 1.75, median 2.5, Q3 = 252.25 -> (1000 - 2.5) / 250.5
    assert math.isclose(got[3][2], (1000 - 2.5) / 250.5)
    assert [g[2] for g in got if g[0] == 2] == [0.0, 0.0]


def test_scale_conf_sizes_partitions_from_input():
    from shoplens.session import scale_conf
    big = scale_conf(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 << 20)
    assert big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == big["spark.sql.shuffle.partitions"]
    small = scale_conf(10**6, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
