"""The availableNow incremental job equals cleaning each file as a batch."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paths import SF001
from shoplens.operators import clean as C
from shoplens.sources import files
from shoplens.sources.fixtures import shop
from shoplens.sources.schemas import RAW_EVENT
from shoplens.streaming.incremental import clean_new_files


def test_incremental_equals_per_file_batch(spark):
    base = files.fresh_path(spark, "stream-test")
    raw = shop(spark, SF001).withColumn("day", F.to_date("event_time").cast("string"))
    raw.repartition("day").write.partitionBy("day").parquet(f"{base}/raw")
    schema = T.StructType(RAW_EVENT.fields + [T.StructField("day", T.StringType())])
    clean_new_files(spark, f"{base}/raw", schema, f"{base}/out", f"{base}/ckpt", 1, drop_cols=("day",))
    got = spark.read.parquet(f"{base}/out").drop("batch").select(*C.CLEAN_COLUMNS)
    days = [r[0] for r in raw.select("day").distinct().collect()]
    exp = None
    for d in days:  # test-side reference only: clean each day's file separately
        part = C.clean_events(raw.filter(F.col("day") == d).drop("day"))
        exp = part if exp is None else exp.unionByName(part)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    # a second run finds no new files and adds nothing
    clean_new_files(spark, f"{base}/raw", schema, f"{base}/out", f"{base}/ckpt", 1, drop_cols=("day",))
    assert spark.read.parquet(f"{base}/out").count() == got.count()


def test_state_of_files_equals_the_batch_over_them(spark):
    """Parts in any order of dates, a retried batch, merged and unmerged parts, a batch without dates."""
    from shoplens.operators import decayed as D
    from shoplens.operators.features import interaction_table
    base = files.fresh_path(spark, "state-test")
    assert D.state_scores(spark, base).count() == 0 and D.compact(spark, base) is None
    events = C.clean_events(shop(spark, SF001))
    days = sorted(r[0] for r in events.select("date").distinct().collect())
    cuts = [days[4:9], days[:4], days[12:], days[9:12]]  # later files may hold earlier dates
    seen = []
    for i, own in enumerate(cuts):
        if i == 2:
            D.write_part(events, base, i)  # a failed attempt with other rows
        D.write_part(events.where(F.col("date").isin(own)), base, i)
        seen += own
        if i == 1:
            assert D.compact(spark, base) == 1 and D.compact(spark, base) is None
        got = {(r.user_id, r.product_id): r.interaction_score for r in D.state_scores(spark, base).collect()}
        want = {(r.user_id, r.product_id): r.interaction_score
                for r in interaction_table(events.where(F.col("date").isin(seen))).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    D.write_part(events.withColumn("date", F.lit(None).cast("date")), base, 4)
    assert D.compact(spark, base) == 4
    again = {(r.user_id, r.product_id): r.interaction_score for r in D.state_scores(spark, base).collect()}
    assert again.keys() == got.keys() and all(abs(got[k] - v) < 1e-9 for k, v in again.items())


def test_the_file_of_a_large_day_is_read_by_several_tasks(spark, tmp_path):
    """One file per day, whose rows are in several row groups where they are many."""
    from shoplens.plans.q_jobs import write_days
    day = F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") % 1000 == 0, F.lit("2024-01-02 01:00:00")).otherwise(F.lit("2024-01-01 23:59:59"))
    events = spark.range(0, 300_000, 1, 3).select(day.cast("timestamp_ntz").alias("event_time"), "id",
                                                  F.sha2(F.col("id").cast("string"), 256).alias("user_session"))
    write_days(events, f"{tmp_path}/raw")
    got = spark.read.parquet(f"{tmp_path}/raw")
    assert got.select("day", F.input_file_name()).distinct().count() == 3
    large = spark.read.parquet(f"{tmp_path}/raw/day=2024-01-01")
    assert large.groupBy(F.spark_partition_id()).count().count() > 1
    assert got.drop("day").exceptAll(events).isEmpty() and got.count() == 300_000
