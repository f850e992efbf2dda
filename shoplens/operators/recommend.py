"""Recommendation: splits, metrics, Spark ML models, two-tower style
scoring and top-n per user, routing policy.

Top-n over embeddings is exact, over a clustered inverted file
(``operators/ivf.py``) or over all pairs of bounded blocks (``exact_topn``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.operators.features import train_table, with_scalars

# Routing policy of the recommender diagram.
ROUTING_THRESHOLD = 100
ROUTING_TIERS = [("new", 1.0, 0.0), ("mixed-80/20", 0.8, 0.2), ("20/80", 0.2, 0.8)]
TRAIN_SHARE = 0.9
_M = 2147483647  # 2^31 - 1
#: Users, or products, of one block on average: a task holds one block of each.
SCORE_BLOCK = 4096
#: Users of a block scored at once.
SCORE_ROWS = 256


# ------------------------------------------------------------ hashing / splits
def mix_hash(*cols, seed: int = 42) -> Column:
    """Portable deterministic hash in [0, 2^31 - 1): Park-Miller steps over
    the key columns. Plain bigint arithmetic that never overflows, so any
    SQL engine computes the same value; stable under repartitioning."""
    h = F.lit(seed % _M).cast("bigint")
    for c in cols:
        x = F.pmod(F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint"), F.lit(_M))
        h = F.pmod((F.pmod(h * F.lit(48271), F.lit(_M)) + x) * F.lit(48271), F.lit(_M))
        h = F.pmod(h * F.lit(16807), F.lit(_M))
    return h


def split_random(df: DataFrame, keys: list[str], train: float = TRAIN_SHARE, seed: int = 42) -> DataFrame:
    """Rows -> train / dev / test by hash bucket (per mille): train below
    ``train``, the rest halved into dev and test."""
    b = F.pmod(mix_hash(*keys, seed=seed), F.lit(1000))
    t = int(round(train * 1000))
    d = t + (1000 - t) // 2
    return df.withColumn("split", F.when(b < t, "train").when(b < d, "dev").otherwise("test"))


def split_disjoint_users(df: DataFrame, train: float = TRAIN_SHARE, seed: int = 42) -> DataFrame:
    """Train users and dev/test users never overlap: the user hash picks
    train, the (user, product) hash halves the rest."""
    ub = F.pmod(mix_hash("user_id", seed=seed), F.lit(1000))
    pb = F.pmod(mix_hash("user_id", "product_id", seed=seed + 1), F.lit(2))
    t = int(round(train * 1000))
    return df.withColumn("split", F.when(ub < t, "train").when(pb == 0, "dev").otherwise("test"))


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Seeded pseudo-random order (a range-partitioned sort on the hash)."""
    return df.orderBy(mix_hash(*keys, seed=seed), *keys)


def factorize_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Dense 0-based index per distinct key in first-seen order.

    Distributed: first-seen per key (hash aggregate), range-partitioned sort,
    a position inside each partition, and per-partition offsets from a table
    with one row per partition -- no single-partition window.
    """
    from shoplens.session import materialize
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    s = first.repartitionByRange("_first", key).sortWithinPartitions("_first", key)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    # written once: positions and counts come from the same partitions
    s = materialize(s.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
                    .select(key, "_pid", "_local"), "factorize")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return s.join(offs, "_pid").select(key, (F.col("_off") + F.col("_local")).alias(f"{key}_index"))


# ------------------------------------------------------------ metrics / routing
def routing_tier(n: Column, threshold: int = ROUTING_THRESHOLD) -> Column:
    return F.when(n <= 0, ROUTING_TIERS[0][0]).when(n < threshold, ROUTING_TIERS[1][0]).otherwise(ROUTING_TIERS[2][0])


def recommend_routing(users: DataFrame, events: DataFrame, list_size: int = 10,
                      threshold: int = ROUTING_THRESHOLD) -> DataFrame:
    """Per user: interactions, tier, and how many slots of a ``list_size``
    list come from random picks and from the recommender."""
    n = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("interactions"))
    u = users.select("user_id").distinct().join(n, "user_id", "left") \
             .withColumn("interactions", F.coalesce("interactions", F.lit(0)))
    tier = routing_tier(F.col("interactions"), threshold)
    rec = (F.when(tier == ROUTING_TIERS[0][0], F.lit(0))
           .when(tier == ROUTING_TIERS[1][0], F.lit(int(round(list_size * ROUTING_TIERS[1][2]))))
           .otherwise(F.lit(int(round(list_size * ROUTING_TIERS[2][2])))))
    return u.select("user_id", "interactions", tier.alias("tier"),
                    (F.lit(list_size) - rec).alias("random_slots"), rec.alias("recommender_slots"))


# Steps of the walk over the product index, primes beyond any
# index they are used with; their product exceeds every 64-bit count, so at
# least one of them does not divide it.
WALK_STEPS = [1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121]


def route_list(routing: DataFrame, recommended: DataFrame, products: DataFrame,
               seen: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Final list per user (user_id, product_id, source): the recommender's
    best ``recommender_slots`` and seeded-random products for all other slots
    of the list; the user has seen none of them, and none comes twice.

    No user x product pairs: products get a dense index (``factorize_ids``)
    and each user walks it from a hashed start by a step that is prime to the
    number of products, so that no index comes twice. The walk is as long as
    the random slots, the seen and the recommended products together, so the
    list is short only when no more products exist. Slots that the recommender
    cannot fill go to random products. ``recommended`` has (user_id,
    product_id, rank), no seen products; ``products`` has product_id.
    """
    users = routing.select("user_id", "random_slots", "recommender_slots")
    r = (recommended.join(users.select("user_id", "recommender_slots"), "user_id")
         .filter(F.col("rank") <= F.col("recommender_slots")).select("user_id", "product_id"))
    idx = factorize_ids(products.select("product_id").distinct(), "product_id", ["product_id"])
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    taken = r if seen is None else r.unionByName(seen.select("user_id", "product_id"))
    taken = taken.distinct()
    counts = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("_taken"))
    picked = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("_picked"))
    want = (users.join(counts, "user_id", "left").join(picked, "user_id", "left")
            .withColumn("_want", F.col("random_slots") + F.col("recommender_slots") - F.coalesce("_picked", F.lit(0))))
    want = with_scalars(want, n).withColumn("_len", F.least(F.col("_n"), F.col("_want") + F.coalesce("_taken", F.lit(0))))
    steps = F.filter(F.array(*[F.lit(p).cast("bigint") for p in WALK_STEPS]), lambda p: F.col("_n") % p != 0)
    step = F.element_at(steps, (F.pmod(mix_hash("user_id", seed=seed + 1), F.size(steps)) + 1).cast("int"))
    walk = (want.filter("_want > 0 and _len > 0")
            .select("user_id", "_want", "_n", F.pmod(mix_hash("user_id", seed=seed), F.col("_n")).alias("_at"),
                    step.alias("_step"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_len") - 1)).alias("_k"))
            .withColumn("product_id_index", F.pmod(F.col("_at") + F.col("_k") * F.pmod(F.col("_step"), F.col("_n")), F.col("_n"))))
    free = walk.join(idx, "product_id_index").join(taken, ["user_id", "product_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("_k")
    rnd = (free.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_want"))
           .select("user_id", "product_id", F.lit("random").alias("source")))
    return r.select("user_id", "product_id", F.lit("recommender").alias("source")).unionByName(rnd)


def ready_for_training(events: DataFrame, key: str, threshold: int = ROUTING_THRESHOLD) -> DataFrame:
    return (events.groupBy(key).agg(F.count(F.lit(1)).alias("interactions"))
            .filter(F.col("interactions") >= threshold))


def topn_per_user(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The best ``n`` products of each user with their rank; scores equal up
    to summation noise rank by product. Spark limits each group before the
    shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round(score, 10)), "product_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# ------------------------------------------------------------ vectors
def l2_normalise(v: Column) -> Column:
    vd = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vd, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vd, lambda x: F.try_divide(x, norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def tower_score(pairs: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Cosine score of given (user_id, product_id) pairs: L2-normalise both
    vectors, dot product (users / products have (id, vector))."""
    u = users.select(F.col("user_id"), l2_normalise(F.col("vector")).alias("_u"))
    p = products.select(F.col("product_id"), l2_normalise(F.col("vector")).alias("_p"))
    j = pairs.join(u, "user_id").join(p, "product_id")
    return j.select("user_id", "product_id", dot(F.col("_u"), F.col("_p")).alias("score"))


def product_vectors(products: DataFrame) -> DataFrame:
    return products.select("product_id", l2_normalise(F.col("vector")).alias("vector"))


# ------------------------------------------------------------ all products, in blocks
def _block_scores(users: DataFrame, products: DataFrame, seen: DataFrame | None, each, schema: str,
                  block: int) -> DataFrame:
    """``each(user ids, product ids, cosines)`` of every block of users with
    every block of products, as frames of ``schema``; product ids ascend, and
    pairs of ``seen`` have the cosine -inf.

    Blocks are hashes of the id, their numbers follow from the counts of both
    sides. A user goes to as many tasks as there are product blocks and the
    other way round; a seen pair goes to the one task that scores it.
    """
    def numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
        d = df.select(F.col(key).cast("bigint").alias(key), F.col("vector").cast("array<double>").alias("vector")
                      ).where(F.col(key).isNotNull() & F.col("vector").isNotNull())
        return d, max(1, -(-d.count() // block))

    u, nu = numbered(users, "user_id")
    p, np_ = numbered(products, "product_id")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<double>")
    ub, pb = (F.pmod(F.xxhash64(k), F.lit(n)) for k, n in (("user_id", nu), ("product_id", np_)))
    rows = u.select(F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))).alias("_o"), ub.alias("_b"), "user_id", "vector") \
            .select((F.col("_b") * np_ + F.col("_o")).alias("cell"), F.lit(0).alias("side"), "user_id",
                    zero.alias("product_id"), "vector")
    rows = rows.unionByName(
        p.select(F.explode(F.sequence(F.lit(0), F.lit(nu - 1))).alias("_o"), pb.alias("_b"), "product_id", "vector")
        .select((F.col("_o") * np_ + F.col("_b")).alias("cell"), F.lit(1).alias("side"), zero.alias("user_id"),
                "product_id", "vector"))
    if seen is not None:
        s = seen.select(F.col("user_id").cast("bigint").alias("user_id"),
                        F.col("product_id").cast("bigint").alias("product_id")).dropna().distinct()
        rows = rows.unionByName(s.select((ub * np_ + pb).alias("cell"), F.lit(2).alias("side"), "user_id",
                                         "product_id", none.alias("vector")))
    return score_cells(rows, each, schema)


def score_cells(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each(user ids, product ids, cosines)`` of every cell of ``rows`` (cell,
    side, user_id, product_id, vector): side 0 are its users, 1 its products, 2
    the seen pairs, whose cosine is -inf. A cell holds one block of each."""
    import pandas as pd

    def unit(part, key):
        """Ids in order and vectors of length one; those of length zero have no direction."""
        if part.empty:
            return np.empty(0, "int64"), np.empty((0, 0))
        part = part.sort_values(key)
        m = np.stack(part["vector"].to_numpy()).astype("float64")
        norm = np.sqrt((m * m).sum(axis=1))
        return part[key].to_numpy("int64")[norm > 0], m[norm > 0] / norm[norm > 0, None]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        uid, uv = unit(pdf[pdf["side"] == 0], "user_id")
        pid, pv = unit(pdf[pdf["side"] == 1], "product_id")
        if not len(uid) or not len(pid):
            return pd.DataFrame(columns=names)
        gone = (pdf.loc[pdf["side"] == 2, ["user_id", "product_id"]]
                .merge(pd.DataFrame({"user_id": uid, "row": np.arange(len(uid))}), on="user_id")
                .merge(pd.DataFrame({"product_id": pid, "col": np.arange(len(pid))}), on="product_id").sort_values("row"))
        row, col = gone["row"].to_numpy("int64"), gone["col"].to_numpy("int64")
        out = []
        for at in range(0, len(uid), SCORE_ROWS):
            cos = uv[at:at + SCORE_ROWS] @ pv.T
            a, b = np.searchsorted(row, [at, at + SCORE_ROWS])
            cos[row[a:b] - at, col[a:b]] = -np.inf
            out.append(each(uid[at:at + SCORE_ROWS], pid, cos))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(names)})

    return rows.groupBy("cell").applyInPandas(run, schema)


def best_of(n: int):
    """The best ``n`` products of each user of a cell, for ``score_cells``."""
    def best(uid, pid, cos):
        r = np.round(cos, 10)
        least = -np.partition(-r, n - 1, axis=1)[:, n - 1] if n < len(pid) else np.full(len(uid), -np.inf)
        who, what, score = [], [], []
        for i in range(len(uid)):
            j = np.flatnonzero((r[i] >= least[i]) & (r[i] > -np.inf))
            j = j[np.argsort(-r[i, j], kind="stable")][:n]  # ties by product
            who.append(np.full(len(j), uid[i])), what.append(pid[j]), score.append(cos[i, j])
        return np.concatenate(who), np.concatenate(what), np.concatenate(score)

    return best


def exact_topn(users: DataFrame, products: DataFrame, seen: DataFrame | None = None, n: int = 10,
               block: int = SCORE_BLOCK) -> DataFrame:
    """Best ``n`` unseen products per user by cosine score, of all products:
    (user_id, product_id, score, rank). Each pair of blocks gives the best
    ``n`` of its users, so no table of all pairs is made; the work is users x
    products. Ids are unique; users and products (id, vector) of length zero
    take no part; a list is short only when no more unseen products exist."""
    found = _block_scores(users, products, seen, best_of(n), "user_id long, product_id long, score double", block)
    return topn_per_user(found, "score", n)


def score_summary(users: DataFrame, products: DataFrame, block: int = SCORE_BLOCK) -> DataFrame:
    """(user_id, scored, best): products that the user is scored against (all
    that have a direction) and the highest cosine among them."""
    def summary(uid, pid, cos):
        return uid, np.full(len(uid), len(pid)), cos.max(axis=1)

    found = _block_scores(users, products, None, summary, "user_id long, scored long, best double", block)
    return found.groupBy("user_id").agg(F.sum("scored").alias("scored"), F.max("best").alias("best"))


# ------------------------------------------------------------ Spark ML
def als_model(interactions: DataFrame, rank: int = 8, max_iter: int = 5, reg: float = 0.1, seed: int = 42):
    """Collaborative filtering on (user_id, product_id, interaction_score):
    (model, user index, product index). The model runs on dense indices, so
    ids may be of any size."""
    from pyspark.ml.recommendation import ALS

    from shoplens.session import materialize
    ui = materialize(factorize_ids(interactions.select("user_id"), "user_id", ["user_id"]), "als-users")
    pi = materialize(factorize_ids(interactions.select("product_id"), "product_id", ["product_id"]), "als-products")
    data = materialize(interactions.join(ui, "user_id").join(pi, "product_id").select(
        F.col("user_id_index").cast("int").alias("user"), F.col("product_id_index").cast("int").alias("item"),
        F.col("interaction_score").cast("float").alias("rating")), "als-ratings")
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, seed=seed, coldStartStrategy="drop", nonnegative=True)
    return als.fit(data), ui, pi


def als_predict(model, ui: DataFrame, pi: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (user_id, product_id, ...) with ``prediction``; pairs with a
    user or product that the model has not learned are left out."""
    p = pairs.join(ui, "user_id").join(pi, "product_id").withColumns({
        "user": F.col("user_id_index").cast("int"), "item": F.col("product_id_index").cast("int")})
    return model.transform(p).drop("user", "item", "user_id_index", "product_id_index")


def als_vectors(model, ui: DataFrame, pi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The learned factors as (user_id, vector) and (product_id, vector)."""
    def of(factors, index, key):
        return (factors.join(index, factors["id"] == index[f"{key}_index"])
                .select(key, F.col("features").cast("array<double>").alias("vector")))
    return of(model.userFactors, ui, "user_id"), of(model.itemFactors, pi, "product_id")


def feature_columns(train: DataFrame) -> list[str]:
    skip = {"user_id", "product_id", "interaction_score", "split"}
    return [c for c, t in train.dtypes if c not in skip and t in ("bigint", "int", "double", "float")]


def feature_vectors(train: DataFrame) -> DataFrame:
    """The train table with its feature columns assembled in ``features``;
    missing values are 0."""
    from pyspark.ml.feature import VectorAssembler
    cols = feature_columns(train)
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    return va.transform(train.na.fill(0.0, subset=cols).na.fill(0, subset=cols))


def content_regressor(train: DataFrame, kind: str = "linear", **params):
    """Pipeline(VectorAssembler, StandardScaler, regressor) predicting the
    interaction score from the user and product features. ``train`` is read
    several times: it should be a stored table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    cols = feature_columns(train)
    va = VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="keep")
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    if kind == "gbt":
        reg = GBTRegressor(featuresCol="features", labelCol="interaction_score", seed=42, **params)
    else:
        reg = LinearRegression(featuresCol="features", labelCol="interaction_score", **params)
    return Pipeline(stages=[va, sc, reg]).fit(train.na.fill(0.0, subset=cols))


# The grid of the random search.
TUNE_GRID = {"recency_days": [7, 15, 30], "weight_decay": [0.3, 0.5, 0.8], "reg_param": [0.0, 0.01, 0.1, 1.0],
             "elastic_net": [0.0, 0.5, 1.0]}


def tune_random_search(events: DataFrame, user: DataFrame, product: DataFrame, draws: int = 4,
                       seed: int = 42) -> list[dict]:
    """Distinct random draws from ``TUNE_GRID``; for each, the interaction
    scores are rebuilt with the drawn recency, a regressor is fitted on the
    train split and scored on the dev split. One dict per draw: parameters,
    rmse, and the rmse over that of predicting the mean (scores of different
    recency have different scales); least of these first."""
    from itertools import product as cross

    from shoplens.operators.analytics import regression_metrics
    from shoplens.operators.features import interaction_table
    from shoplens.session import materialize
    grid = list(cross(*TUNE_GRID.values()))
    rng = np.random.default_rng(seed)
    out = []
    for i in sorted(rng.choice(len(grid), size=min(draws, len(grid)), replace=False).tolist()):
        own = dict(zip(TUNE_GRID, grid[i]))
        scores = interaction_table(events, own["recency_days"], own["weight_decay"])
        data = materialize(split_random(train_table(scores, user, product), ["user_id", "product_id"]), "tune")
        model = content_regressor(data.filter("split = 'train'").drop("split"), regParam=own["reg_param"],
                                  elasticNetParam=own["elastic_net"])
        dev = predict(model, data.filter("split = 'dev'"))
        mean = data.filter("split = 'train'").agg(F.avg("interaction_score")).first()[0]
        own["rmse"] = regression_metrics(dev, "interaction_score", "prediction").first()["rmse"]
        base = regression_metrics(dev.withColumn("_m", F.lit(mean)), "interaction_score", "_m").first()["rmse"]
        own["share_of_mean_rmse"] = own["rmse"] / base if base else None
        out.append(own)
    return sorted(out, key=lambda x: (x["share_of_mean_rmse"] is None, x["share_of_mean_rmse"]))


def predict(model, rows: DataFrame) -> DataFrame:
    cols = feature_columns(rows)
    return model.transform(rows.na.fill(0.0, subset=cols).na.fill(0, subset=cols))


def model_versions(spark, base: str) -> tuple[int, int]:
    """(latest, next) numbered model folder ``v<N>`` under ``base``, on
    whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    latest = max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)
    return latest, latest + 1


def save_versioned(spark, model, base: str) -> str:
    """Save under the next number; an existing version is never replaced."""
    path = f"{base.rstrip('/')}/v{model_versions(spark, base)[1]}"
    model.write().save(path)
    return path
