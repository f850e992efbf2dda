"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import materialize

__all__ = ["anti_rows", "hex64", "keyed", "materialize", "row_key", "semi_rows", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, text): only the two named columns are read, whatever
    else the input holds, and each input row gets a number of its own, so
    that repeated rows stay apart. The number is stable only inside one
    evaluation: write what carries it (``materialize``) before using it twice.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"))


def row_key(text: Column) -> Column:
    """Second part of a row's key beside its id: separates rows that share an
    id but not a text. Null and empty texts differ."""
    return F.xxhash64(text, text.isNull())


def _on(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[f"__{k}"].eqNullSafe(right[k])
    return cond


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"__doc_id": F.col(f"`{id_col}`"), "__key": row_key(F.col(f"`{text_col}`"))})


def semi_rows(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose (id, key) is in ``keep(doc_id, key)``; with
    ``once``, one row per (id, key). All columns of ``docs`` are returned."""
    d = _keys(docs, id_col, text_col)
    keep = keep.select("doc_id", "key")
    out = d.join(keep, _on(["doc_id", "key"], d, keep), "left_semi")
    if once:
        out = out.dropDuplicates(["__doc_id", "__key"])
    return out.drop("__doc_id", "__key")


def anti_rows(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, key) is not in ``drop(doc_id, key)``."""
    d = _keys(docs, id_col, text_col)
    drop = drop.select("doc_id", "key")
    return d.join(drop, _on(["doc_id", "key"], d, drop), "left_anti").drop("__doc_id", "__key")


def hex64(value: Column) -> Column:
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
