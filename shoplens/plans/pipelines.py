"""Batch jobs: raw events -> clean table -> feature tables.

Each job reads whole inputs, writes parquet to the given location and is
safe to re-run (overwrite). The enriched events (M3) feed four aggregates,
so they are materialised once with a reliable checkpoint in the shared
checkpoint folder instead of being recomputed four times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplens.operators import clean as C
from shoplens.operators import features as FE
from shoplens.session import materialize
from shoplens.sources import files


def clean_job(raw: DataFrame, out_path: str, fmt: str = "parquet") -> str:
    """M1 -> M2, written partitioned by date."""
    files.write_clean(C.clean_events(raw), out_path, fmt)
    return out_path


def feature_job(spark: SparkSession, clean_path: str, out_path: str) -> dict[str, str]:
    """Clean table -> product, user, interaction and train tables."""
    clean = spark.read.parquet(clean_path)
    if "date" not in clean.columns:
        raise ValueError("input is not a clean event table (no date column); run clean_job first")
    m3 = materialize(FE.relative_price(clean.select(*C.CLEAN_COLUMNS)))
    product = FE.product_table(m3)
    user = FE.user_table(m3)
    inter = FE.interaction_table(m3)
    out = {}
    for name, df in (("product", product), ("user", user), ("interaction", inter)):
        out[name] = f"{out_path}/{name}"
        files.write_table(df, out[name])
    # the train table joins the written tables, not their plans
    t = FE.train_table(spark.read.parquet(out["interaction"]), spark.read.parquet(out["user"]),
                       spark.read.parquet(out["product"]))
    out["train"] = f"{out_path}/train"
    files.write_table(t, out["train"])
    return out
