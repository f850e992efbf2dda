"""Registry of named queries: a Spark builder and its SQL twin.

``queries()`` / ``oracle_sql()`` of ``__spark_entry__`` are read from here.
Every builder takes (spark, sf_dir) and reads the whole given tables (or
views Spark derives from them). For the comparison with the SQL twin alone,
floating columns of a registered query are snapped to multiples of 2^-20 on
both sides; the operators themselves return unrounded values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shoplens.functions.columns import round6
from shoplens.plans.oracle import round_floats, sql_with


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    floats: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Entry] = {}


def register(name: str, uses: list[str] | None = None, sql: str | None = None,
             floats: tuple[str, ...] | list[str] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``
    with its SQL twin (``uses`` = CTE names the twin selects from)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = sql_with(uses or [], sql) if sql is not None else None
        REGISTRY[name] = Entry(name, fn, full, tuple(floats))
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Snap every floating column to a multiple of 2^-20 (and fold -0.0)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round6(f.name).alias(f.name))
        else:
            out.append(df[f.name])
    return df.select(*out)


def _load_all():
    # importing the query modules fills REGISTRY
    from shoplens.plans import (q_clean, q_features, q_analytics,  # noqa: F401
                                q_catalog, q_search, q_recommend, q_jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: (lambda spark, sf, _e=e: finish(_e.build(spark, sf))) for n, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: round_floats(e.sql, e.floats) for n, e in REGISTRY.items() if e.sql is not None}
