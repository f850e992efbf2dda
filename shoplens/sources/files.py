"""File sources and sinks (CSV, text, parquet) with explicit schemas.

The reference only reads and writes CSV / text files; we read them with a
fixed schema (no inference pass) and write parquet partitioned by date where
the data has one, so later filters prune whole directories.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import scratch_path
from shoplens.sources.schemas import RAW_CATALOG, RAW_EVENT_CSV, SENTIMENT

EVENT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Monthly raw event CSV -> M1; event_time parsed leniently
    (``try_to_timestamp``: an unparsable time becomes null, it does not fail
    the job)."""
    df = spark.read.schema(RAW_EVENT_CSV).option("header", True).csv(path)
    ts = F.try_to_timestamp(F.col("event_time"), F.lit(EVENT_TIME_FORMAT)).cast("timestamp_ntz")
    return df.withColumn("event_time", ts)


def write_events_csv(df: DataFrame, path: str) -> None:
    out = df.withColumn("event_time", F.date_format("event_time", EVENT_TIME_FORMAT))
    out.write.mode("overwrite").option("header", True).csv(path)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw catalogue CSV: free text with quotes and line breaks."""
    return (spark.read.schema(RAW_CATALOG).option("header", True).option("enforceSchema", False)
            .option("multiLine", True).option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_sentiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pre-computed sentiment file: the score columns, distinct rows."""
    return (spark.read.schema(SENTIMENT).option("header", True).csv(path)
            .select("product_id", "neg", "neu", "pos", "compound").distinct())


def read_word_bank(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file, one word per line -> (word) rows (a set, not one
    string)."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter(F.length("word") > 0).distinct()


def write_word_bank(words: DataFrame, path: str) -> None:
    words.select("word").distinct().write.mode("overwrite").text(path)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Clean events partitioned by date (partition pruning for later
    date filters); CSV on request."""
    w = df.write.mode("overwrite").partitionBy("date")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint location."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
