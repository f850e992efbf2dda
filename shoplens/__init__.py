"""shoplens: e-commerce behaviour analytics as Spark DataFrame transforms.

Every operator is a pure ``DataFrame -> DataFrame`` function built from
Spark's built-in column expressions, so Catalyst can push filters into the
parquet scan, prune columns and pick the join strategy.
"""

__version__ = "0.1.0"
