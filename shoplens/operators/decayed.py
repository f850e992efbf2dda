"""Interaction scores that add up over files: mergeable, decayed sums.

A score is a sum of event weights, each halved every so many days before the
last date. A part of the events gives partial sums as of its own last date;
moving them to a later date multiplies all of them by one factor, so parts are
merged by re-basing and adding, in any order, without reading events again.

A state folder holds one part per micro-batch (``parts/batch=<id>``, replaced
when the batch is retried) and merged bases (``base/upto=<id>``) of all parts up
to a batch. A base counts once its write has ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.columns import half_life_coef
from shoplens.operators.features import (DEFAULT_RECENCY_DAYS, DEFAULT_WEIGHT_DECAY, DEFAULT_WEIGHTS, recency,
                                         with_scalars)

STATE = "user_id bigint, product_id bigint, score double, as_of date"


def event_weight(weights: dict[str, float] | None = None) -> Column:
    """The weight of a row's event type; other types weigh nothing."""
    pairs = [x for t, w in (weights or DEFAULT_WEIGHTS).items() for x in (F.lit(t), F.lit(float(w)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event_type")), F.lit(0.0))


def partial_scores(events: DataFrame, recency_days: float = DEFAULT_RECENCY_DAYS,
                   weight_decay: float = DEFAULT_WEIGHT_DECAY, weights: dict[str, float] | None = None) -> DataFrame:
    """(user_id, product_id, score, as_of) of a part of the events: unclamped
    sums as of the part's last date. Events without a date weigh nothing; a part
    without dates has none to stand for and is empty."""
    own = recency(events.where("date is not null"), recency_days, weight_decay)
    sums = own.groupBy("user_id", "product_id").agg(F.sum(event_weight(weights) * F.col("recency_coef")).alias("score"))
    return with_scalars(sums, events.agg(F.max("date").alias("as_of")))


def merge_scores(parts: DataFrame, recency_days: float = DEFAULT_RECENCY_DAYS,
                 weight_decay: float = DEFAULT_WEIGHT_DECAY) -> DataFrame:
    """Parts (user_id, product_id, score, as_of) of any dates -> one row per
    pair as of the last of them. Merging merged parts gives the same."""
    d = with_scalars(parts, parts.agg(F.max("as_of").alias("_last")))
    moved = F.col("score") * half_life_coef(F.datediff("_last", "as_of"), weight_decay, recency_days)
    return (d.groupBy("user_id", "product_id").agg(F.sum(moved).alias("score"), F.max("_last").alias("as_of")))


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished sub-folders ``<prefix><number>``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def write_part(events: DataFrame, state_dir: str, batch_id: int, **decay) -> None:
    """Adds the events of a batch; a batch that is written again replaces itself."""
    (partial_scores(events, **decay).select("user_id", "product_id", "score", "as_of")
     .write.mode("overwrite").parquet(f"{state_dir}/parts/batch={batch_id}"))


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The newest base and the parts behind it: (user_id, product_id, score, as_of)."""
    bases = _folders(spark, f"{state_dir}/base", "upto=")
    upto = bases[-1] if bases else -1
    paths = [f"{state_dir}/base/upto={upto}"] if bases else []
    paths += [f"{state_dir}/parts/batch={b}" for b in _folders(spark, f"{state_dir}/parts", "batch=") if b > upto]
    if not paths:
        return spark.createDataFrame([], STATE)
    return spark.read.parquet(*paths).select("user_id", "product_id", "score", "as_of")


def compact(spark: SparkSession, state_dir: str, **decay) -> int | None:
    """Merges the base and all parts into a new base; the number of the last
    batch in it, None if there is nothing to merge. Older folders stay."""
    done, bases = (_folders(spark, f"{state_dir}/{d}", p) for d, p in (("parts", "batch="), ("base", "upto=")))
    if not done or (bases and bases[-1] >= done[-1]):
        return None
    merge_scores(read_state(spark, state_dir), **decay).write.mode("overwrite").parquet(f"{state_dir}/base/upto={done[-1]}")
    return done[-1]


def state_scores(spark: SparkSession, state_dir: str, **decay) -> DataFrame:
    """(user_id, product_id, interaction_score) as of the last date of the
    state, clamped as ``features.interaction_table`` does."""
    s = merge_scores(read_state(spark, state_dir), **decay)
    return s.select("user_id", "product_id",
                    F.least(F.greatest("score", F.lit(0.0)), F.lit(100.0)).alias("interaction_score"))
