"""Incremental processing of raw event files (the monthly job).

A file-stream over the raw directory with ``trigger(availableNow=True)``
processes exactly the files not yet recorded in the checkpoint, in
micro-batches of ``files_per_batch`` files, and stops. Every micro-batch is
cleaned with the same batch transforms, its features are built, and all are
written to their own ``batch=<id>`` folders with overwrite, so a batch retried after a failure
replaces its own output (idempotent sink); the checkpoint lives in the
shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shoplens.operators import clean as C
from shoplens.operators import decayed
from shoplens.operators import features as FE
from shoplens.session import materialize


def clean_new_files(spark: SparkSession, raw_dir: str, schema: T.StructType, out_dir: str,
                    checkpoint: str, files_per_batch: int = 1, fmt: str = "parquet",
                    drop_cols: tuple[str, ...] = (), features_dir: str | None = None,
                    features: tuple[str, ...] = ("product", "user", "interaction"),
                    state_dir: str | None = None, compact_every: int = 16) -> None:
    """``features_dir``: also write the tables named by ``features`` of each
    micro-batch there. ``state_dir``: also add each micro-batch to the
    interaction state there (``operators/decayed.py``), whose scores are those
    of all batches together; its parts are merged every ``compact_every``
    batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.format(fmt).load(raw_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        df = batch.drop(*drop_cols) if drop_cols else batch
        clean = C.clean_events(df)
        clean.write.mode("overwrite").partitionBy("date").parquet(f"{out_dir}/batch={batch_id}")
        if features_dir or state_dir:
            own = spark.read.parquet(f"{out_dir}/batch={batch_id}").select(*C.CLEAN_COLUMNS)
        if state_dir:
            decayed.write_part(own, state_dir, batch_id)
            if batch_id % compact_every == compact_every - 1:
                decayed.compact(spark, state_dir)
        if features_dir:
            builds = {"product": FE.product_table, "user": FE.user_table, "interaction": FE.interaction_table}
            # the interaction scores need no relative prices
            events = own if features == ("interaction",) else materialize(FE.relative_price(own), "batch-events")
            for name in features:
                builds[name](events).write.mode("overwrite").parquet(f"{features_dir}/{name}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
