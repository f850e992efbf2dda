"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins at runtime (broadcast only
# when the measured side is below autoBroadcastJoinThreshold) and splits
# skewed shuffle partitions; the session time zone is pinned so dates derived
# from timestamps do not depend on the machine.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, total_cores: int, target_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster, from the input size and the
    number of executor cores.

    The initial shuffle partition count gives every reducer about
    ``target_bytes`` of a shuffle as large as the input (at least two waves
    of the cores); AQE then coalesces the partitions that come out small and
    splits the skewed ones, so over-provisioning costs little while too few
    partitions spill. 100 TB on 1000 executors x 8 cores -> ~400k initial
    partitions, coalesced at run time to the measured sizes.
    """
    parts = max(2 * total_cores, -(-int(input_bytes) // target_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_bytes),
    }


def build_session(master: str | None = None, app: str = "shoplens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, a folder of its own is shared enough
        conf["spark.driver.memory"] = os.environ.get("SHOPLENS_DRIVER_MEMORY", "16g")
        conf["spark.checkpoint.dir"] = _own_folder()
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """This process's folder for local runs; it goes with the process."""
    d = tempfile.mkdtemp(prefix="shoplens-ckpt-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is what ``spark.checkpoint.dir`` names (a folder that
    driver and executors share); without it nothing may be written, so an
    unset folder raises. Only a ``local`` master, where the driver is the one
    executor, gets a folder of its own, made once per process.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = _own_folder()  # the setting itself cannot be changed in a running session
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"


def materialize(df, name: str = "stage"):
    """Cut the lineage of ``df`` by writing it as parquet to a new folder
    under the shared checkpoint location and reading it back.

    Computed once (a reliable ``checkpoint()`` evaluates the plan twice);
    later consumers -- several aggregates, ML optimisers that pass over the
    data many times -- scan the written files, which also give AQE real
    sizes. A lost executor costs a re-read of shared files, not a
    recomputation of the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
