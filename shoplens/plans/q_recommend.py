"""Registered queries: splits, indexing, scoring, top-n, routing and the
Spark ML models (SURVEY 2.4, 2.6, 2.11)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from shoplens.operators import features as FE
from shoplens.operators import recommend as R
from shoplens.operators.ivf import ivf_topn
from shoplens.plans.oracle import mix_hash_sql
from shoplens.plans.q_clean import clean
from shoplens.plans.q_features import enriched
from shoplens.plans.registry import register
from shoplens.sources import files
from shoplens.sources.tables import load_table


def emb_users(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.filter(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector"))


def emb_products(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.filter(F.col("vec_id") % 10 != 0).select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))


def emb_seen(spark, sf):
    """Each product is 'seen' by the user vector that opens its block of ten."""
    p = emb_products(spark, sf).select("product_id")
    u = emb_users(spark, sf).select("user_id")
    return p.join(u, F.col("user_id") == F.col("product_id") - F.col("product_id") % 10).select("user_id", "product_id")


def _stage(spark, sf, name, build):
    from shoplens.plans.stages import shared
    return shared(spark, sf, name, build)


def emb_topn(spark, sf):
    """The best ten unseen products of every user, one stage for the entries that list them."""
    return _stage(spark, sf, "emb_topn", lambda: ivf_topn(
        emb_users(spark, sf), emb_products(spark, sf), emb_seen(spark, sf), n=10))


def interactions(spark, sf):
    return _stage(spark, sf, "interactions", lambda: FE.interaction_table(enriched(spark, sf)))


def users(spark, sf):
    return _stage(spark, sf, "users", lambda: FE.user_table(enriched(spark, sf)))


def products_tbl(spark, sf):
    return _stage(spark, sf, "products", lambda: FE.product_table(enriched(spark, sf)))


def train_table(spark, sf):
    return FE.train_table(interactions(spark, sf), users(spark, sf), products_tbl(spark, sf))


@register("train_table", ["interaction", "user_tbl", "product_tbl"], """
 select i.user_id, i.product_id, i.interaction_score,
  u.views as views_user, u.carts as carts_user, u.remove_from_carts as remove_from_carts_user,
  u.purchases as purchases_user, u.avg_view_price, u.avg_purchase_price, u.avg_view_relative_price,
  u.avg_purchase_relative_price, u.distinct_view_product, u.distinct_cart_product, u.distinct_remove_product,
  u.distinct_purchase_product, u.cart_per_view as cart_per_view_user, u.purchase_per_view as purchase_per_view_user,
  u.remove_per_cart as remove_per_cart_user, u.purchase_per_cart as purchase_per_cart_user,
  p.category_id, p.avg_price, p.relative_price, p.views as views_product, p.carts as carts_product,
  p.remove_from_carts as remove_from_carts_product, p.purchases as purchases_product,
  p.cart_per_view as cart_per_view_product, p.purchase_per_view as purchase_per_view_product,
  p.remove_per_cart as remove_per_cart_product, p.purchase_per_cart as purchase_per_cart_product
 from interaction i left join user_tbl u on i.user_id = u.user_id left join product_tbl p on i.product_id = p.product_id""",
          floats=["interaction_score", "avg_view_price", "avg_purchase_price", "avg_view_relative_price",
                  "avg_purchase_relative_price", "cart_per_view_user", "purchase_per_view_user",
                  "remove_per_cart_user", "purchase_per_cart_user", "avg_price", "relative_price",
                  "cart_per_view_product", "purchase_per_view_product", "remove_per_cart_product",
                  "purchase_per_cart_product"])
def q_train_table(spark, sf):
    return train_table(spark, sf)


@register("left_join_chain", ["user_tbl", "product_tbl", "interaction"], """
 select i.user_id, i.product_id, i.interaction_score, u.views as views_x, u.purchases, p.views as views_y, p.avg_price
 from interaction i left join user_tbl u on i.user_id = u.user_id
 left join product_tbl p on i.product_id = p.product_id""", floats=["interaction_score", "avg_price"])
def q_left_join_chain(spark, sf):
    return FE.left_join_chain(
        [interactions(spark, sf), users(spark, sf).select("user_id", "views", "purchases"),
         products_tbl(spark, sf).select("product_id", "views", "avg_price")],
        ["user_id", "product_id"], [("_x", "_y"), ("_x", "_y")])


@register("factorize_ids", ["clean"], """
 select user_id, row_number() over (order by f, user_id) - 1 as user_id_index from
 (select user_id, min(strftime(date, '%Y-%m-%d') || ' ' || time) as f from clean group by user_id)""")
def q_factorize_ids(spark, sf):
    return R.factorize_ids(clean(spark, sf), "user_id", ["date", "time"])


@register("split_random", ["interaction"], f"""
 select user_id, product_id, case when {mix_hash_sql('user_id', 'product_id')} % 1000 < 900 then 'train'
  when {mix_hash_sql('user_id', 'product_id')} % 1000 < 950 then 'dev' else 'test' end as split
 from interaction""")
def q_split_random(spark, sf):
    return R.split_random(interactions(spark, sf), ["user_id", "product_id"]).select("user_id", "product_id", "split")


@register("split_disjoint_users", ["interaction"], f"""
 select user_id, product_id, case when {mix_hash_sql('user_id')} % 1000 < 900 then 'train'
  when {mix_hash_sql('user_id', 'product_id', seed=43)} % 2 = 0 then 'dev' else 'test' end as split
 from interaction""")
def q_split_disjoint_users(spark, sf):
    return R.split_disjoint_users(interactions(spark, sf)).select("user_id", "product_id", "split")


@register("shuffle_rows", ["interaction"], "select * from interaction", floats=["interaction_score"])
def q_shuffle_rows(spark, sf):
    return R.shuffle_rows(interactions(spark, sf), ["user_id", "product_id"])


@register("sort_by_user", ["user_tbl"], "select user_id, views, purchases from user_tbl")
def q_sort_by_user(spark, sf):
    u = FE.user_table(enriched(spark, sf)).select("user_id", "views", "purchases")
    return u.repartition("user_id").sortWithinPartitions("user_id")


@register("standard_scale", ["user_tbl"], """
 select user_id, (views - avg(views) over ()) / nullif(stddev_pop(views) over (), 0) as views,
  (purchases - avg(purchases) over ()) / nullif(stddev_pop(purchases) over (), 0) as purchases,
  (avg_view_price - avg(avg_view_price) over ()) / nullif(stddev_pop(avg_view_price) over (), 0) as avg_view_price
 from user_tbl""", floats=["views", "purchases", "avg_view_price"])
def q_standard_scale(spark, sf):
    from shoplens.operators.analytics import standard_scale
    return standard_scale(FE.user_table(enriched(spark, sf)), ["views", "purchases", "avg_view_price"], "user_id")


@register("tower_score", ["emb_seen", "emb_users", "emb_products"], """
 select s.user_id, s.product_id, list_cosine_similarity(u.embedding::double[], p.embedding::double[]) as score
 from emb_seen s join emb_users u on s.user_id = u.user_id join emb_products p on s.product_id = p.product_id""",
          floats=["score"])
def q_tower_score(spark, sf):
    return R.tower_score(emb_seen(spark, sf), emb_users(spark, sf), emb_products(spark, sf))


@register("recommend_topn", ["emb_topn"], "select * from emb_topn", floats=["score"])
def q_recommend_topn(spark, sf):
    return emb_topn(spark, sf)


@register("win_topn_per_user", ["interaction"], """
 select * from (select *, row_number() over (partition by user_id
   order by round(interaction_score, 10) desc, product_id) as rank from interaction) where rank <= 10""",
          floats=["interaction_score"])
def q_win_topn_per_user(spark, sf):
    return R.topn_per_user(interactions(spark, sf), "interaction_score", 10)


@register("exclude_seen", ["emb_seen", "emb_users", "emb_products"], """
 select u.user_id, count(*) as unseen from emb_users u, emb_products p
 where not exists (select 1 from emb_seen s where s.user_id = u.user_id and s.product_id = p.product_id)
 group by u.user_id""")
def q_exclude_seen(spark, sf):
    # per user: products minus seen = |products| - |seen of user|, no pairs
    n = emb_products(spark, sf).agg(F.count(F.lit(1)).alias("_n"))
    s = emb_seen(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("_s"))
    u = FE.with_scalars(emb_users(spark, sf).select("user_id").join(s, "user_id", "left"), n)
    return u.select("user_id", (F.col("_n") - F.coalesce("_s", F.lit(0))).alias("unseen"))


@register("routing_slots", ["clean"], """
 with u as (select c_custkey as user_id from customer union select user_id from clean),
 n as (select user_id, count(*) as interactions from clean group by user_id)
 select u.user_id, coalesce(n.interactions, 0) as interactions,
  case when coalesce(n.interactions, 0) <= 0 then 'new' when coalesce(n.interactions, 0) < 100 then 'mixed-80/20'
   else '20/80' end as tier,
  10 - case when coalesce(n.interactions, 0) <= 0 then 0 when coalesce(n.interactions, 0) < 100 then 2 else 8 end
   as random_slots,
  case when coalesce(n.interactions, 0) <= 0 then 0 when coalesce(n.interactions, 0) < 100 then 2 else 8 end
   as recommender_slots
 from u left join n on u.user_id = n.user_id""")
def q_routing_slots(spark, sf):
    users = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    c = clean(spark, sf)
    users = users.unionByName(c.select("user_id"))
    return R.recommend_routing(users, c).select(
        "user_id", F.col("interactions").cast("bigint").alias("interactions"), "tier",
        F.col("random_slots").cast("int").alias("random_slots"),
        F.col("recommender_slots").cast("int").alias("recommender_slots"))


_STEPS = "[" + ", ".join(map(str, R.WALK_STEPS)) + "]"


@register("recommend_routing", ["routing", "emb_topn", "emb_seen", "emb_products"], f"""
 with idx as (select product_id, row_number() over (order by product_id) - 1 as i, count(*) over () as n from emb_products),
 r as (select t.user_id, t.product_id from emb_topn t join routing o on t.user_id = o.user_id where t.rank <= o.slots),
 taken as (select user_id, product_id from r union select user_id, product_id from emb_seen),
 w as (select o.user_id, 10 - (select count(*) from r where r.user_id = o.user_id) as want,
   (select count(*) from taken where taken.user_id = o.user_id) as taken, (select max(n) from idx) as n from routing o),
 walk as (select user_id, want, n, unnest(range(least(n, want + taken))) as k,
   ({mix_hash_sql('user_id', seed=42)}) % n as start,
   list_filter({_STEPS}, lambda p: n % p <> 0) as steps from w),
 free as (select walk.user_id, idx.product_id, want, k from walk
   join idx on idx.i = (start + k * (steps[({mix_hash_sql('user_id', seed=43)}) % len(steps) + 1] % walk.n)) % walk.n
   where not exists (select 1 from taken where taken.user_id = walk.user_id and taken.product_id = idx.product_id))
 select user_id, product_id, 'recommender' as source from r
 union all select user_id, product_id, 'random' as source from (
  select *, row_number() over (partition by user_id order by k) as rn from free) where rn <= want""")
def q_recommend_routing(spark, sf):
    """The routed list of ten products for every customer, event user and user
    vector; a user without a vector has no recommended products, only random ones."""
    u, p, seen = emb_users(spark, sf), emb_products(spark, sf), emb_seen(spark, sf)
    c = clean(spark, sf)
    users = (load_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
             .unionByName(c.select("user_id")).unionByName(u.select("user_id")))
    return R.route_list(R.recommend_routing(users, c), emb_topn(spark, sf), p, seen)


@register("ready_for_training", ["clean"], """
 select product_id, count(*) as interactions from clean group by product_id having count(*) >= 100""")
def q_ready_for_training(spark, sf):
    return R.ready_for_training(clean(spark, sf), "product_id")


@register("user_content", ["user_tbl", "clean"], """
 select * from user_tbl where user_id in (select user_id from clean where event_type = 'purchase')""",
          floats=["avg_view_price", "avg_purchase_price", "avg_view_relative_price", "avg_purchase_relative_price",
                  "cart_per_view", "purchase_per_view", "remove_per_cart", "purchase_per_cart"])
def q_user_content(spark, sf):
    c = clean(spark, sf)
    buyers = c.filter(F.col("event_type") == "purchase").select("user_id")
    return FE.user_table(FE.relative_price(c)).join(buyers, "user_id", "left_semi")


@register("user_pairs_lookup", ["interaction", "clean"], """
 select * from interaction where user_id in (select user_id from clean where event_type = 'purchase')""",
          floats=["interaction_score"])
def q_user_pairs_lookup(spark, sf):
    c = clean(spark, sf)
    buyers = c.filter(F.col("event_type") == "purchase").select("user_id")
    return FE.interaction_table(FE.relative_price(c)).join(buyers, "user_id", "left_semi")


@register("cross_score", ["emb_scored"], """
 select user_id, count(*) as scored, max(score) as best from emb_scored group by user_id""", floats=["best"])
def q_cross_score(spark, sf):
    """Scores of every user against every product."""
    return R.score_summary(emb_users(spark, sf), emb_products(spark, sf))


# ------------------------------------------------------------ ML (rows-only checks)
@register("product_vectors", [], """
 with v as (select vec_id, embedding::double[] as e from embeddings),
 n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v)
 select vec_id as product_id, unnest(range(len(e)))::int as place,
  unnest(list_transform(e, lambda x: case when norm = 0 then null else x / norm end)) as value from n""",
          floats=["value"])
def q_product_vectors(spark, sf):
    """Every vector, one row per component."""
    e = load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))
    return R.product_vectors(e).select("product_id", F.posexplode("vector").alias("place", "value"))


# The feature columns of the train table in their order.
_FEATURES = ["views_user", "carts_user", "remove_from_carts_user", "purchases_user", "avg_view_price",
             "avg_purchase_price", "avg_view_relative_price", "avg_purchase_relative_price",
             "distinct_view_product", "distinct_cart_product", "distinct_remove_product",
             "distinct_purchase_product", "cart_per_view_user", "purchase_per_view_user", "remove_per_cart_user",
             "purchase_per_cart_user", "category_id", "avg_price", "relative_price", "views_product",
             "carts_product", "remove_from_carts_product", "purchases_product", "cart_per_view_product",
             "purchase_per_view_product", "remove_per_cart_product", "purchase_per_cart_product"]


def _feature_sql():
    own = {"views_user": "u.views", "carts_user": "u.carts", "remove_from_carts_user": "u.remove_from_carts",
           "purchases_user": "u.purchases", "views_product": "p.views", "carts_product": "p.carts",
           "remove_from_carts_product": "p.remove_from_carts", "purchases_product": "p.purchases"}
    sides = {c: ("p." if c in ("category_id", "avg_price", "relative_price") else "u.") + c for c in _FEATURES}
    for side in ("user", "product"):
        for c in FE.RATE_COLUMNS:
            sides[f"{c}_{side}"] = f"{side[0]}.{c}"
    return ", ".join(f"coalesce({(sides | own)[c]}, 0)::double" for c in _FEATURES)


@register("feature_vectors", ["interaction", "user_tbl", "product_tbl"], f"""
 select user_id, product_id, unnest(range({len(_FEATURES)}))::int as place, unnest(f) as value from (
  select i.user_id, i.product_id, [{_feature_sql()}] as f from interaction i
  left join user_tbl u on i.user_id = u.user_id left join product_tbl p on i.product_id = p.product_id)""",
          floats=["value"])
def q_feature_vectors(spark, sf):
    """The assembled vector of every pair, one row per component."""
    from pyspark.ml.functions import vector_to_array
    t = train_table(spark, sf)
    v = R.feature_vectors(t)
    return v.select("user_id", "product_id", F.posexplode(vector_to_array("features")).alias("place", "value"))


def _split_train(spark, sf):
    return _stage(spark, sf, "split_train", lambda: R.split_random(train_table(spark, sf), ["user_id", "product_id"]))


def _als(spark, sf):
    pairs = R.split_random(interactions(spark, sf), ["user_id", "product_id"])
    return pairs, R.als_model(pairs.filter("split = 'train'"))


@register("als_model")
def q_als_model(spark, sf):
    """Predictions of the held-out pairs."""
    pairs, (model, ui, pi) = _als(spark, sf)
    held = pairs.filter("split <> 'train'")
    return R.als_predict(model, ui, pi, held).select(
        "user_id", "product_id", "split", "interaction_score", F.col("prediction").cast("double").alias("prediction"))


@register("als_topn")
def q_als_topn(spark, sf):
    """Best unseen products by the vectors that the model has learned."""
    pairs, (model, ui, pi) = _als(spark, sf)
    u, p = R.als_vectors(model, ui, pi)
    return ivf_topn(u.where("user_id % 100 = 0"), R.product_vectors(p), interactions(spark, sf), n=10)


@register("content_regressor")
def q_content_regressor(spark, sf):
    t = _split_train(spark, sf)
    m = R.content_regressor(t.filter("split = 'train'").drop("split"))
    return R.predict(m, t.filter("split <> 'train'")).select(
        "user_id", "product_id", "split", "interaction_score", "prediction")


@register("model_metrics")
def q_model_metrics(spark, sf):
    """The regressor and the mean of the train split, judged on dev and test."""
    from shoplens.operators.analytics import regression_metrics
    t = _split_train(spark, sf)
    train = t.filter("split = 'train'").drop("split")
    pred = R.predict(R.content_regressor(train), t.filter("split <> 'train'"))
    pred = FE.with_scalars(pred, train.agg(F.avg("interaction_score").alias("mean")))
    parts = [regression_metrics(pred.filter(F.col("split") == s), "interaction_score", c)
             .select(F.lit(s).alias("split"), F.lit(name).alias("model"), "mae", "mse", "rmse")
             for s in ("dev", "test") for name, c in (("regressor", "prediction"), ("mean", "mean"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@register("tune_random_search")
def q_tune_random_search(spark, sf):
    rows = R.tune_random_search(enriched(spark, sf), users(spark, sf), products_tbl(spark, sf), draws=4)
    return spark.createDataFrame([(json.dumps({k: r[k] for k in R.TUNE_GRID}, sort_keys=True), float(r["rmse"]),
                                   float(r["share_of_mean_rmse"])) for r in rows],
                                 "params string, rmse double, share_of_mean_rmse double")


@register("model_versions")
def q_model_versions(spark, sf):
    """Predictions by the latest of two saved versions, loaded again."""
    from pyspark.ml import PipelineModel
    t = _split_train(spark, sf)
    base = files.fresh_path(spark, "models")
    for part in ("train", "dev"):
        R.save_versioned(spark, R.content_regressor(t.filter(F.col("split") == part).drop("split")), base)
    latest, _ = R.model_versions(spark, base)
    m = PipelineModel.load(f"{base}/v{latest}")
    return R.predict(m, t.filter("split = 'test'")).select(F.lit(latest).alias("version"), "user_id", "product_id",
                                                           "prediction")
