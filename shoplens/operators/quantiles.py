"""Exact quantiles per group by refined histograms, with no sort of all values.

Equal values are counted first (map-side combine). A histogram of each group
over its range of values, in a scale in which any doubles are spread out,
says which bins hold the ranks that are asked for; only their values are looked
at further, in a histogram of each of these bins, until a bin holds few values
or one. These few are ranked. Each histogram is a count with map-side combine;
what is kept of it is a few bins a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a histogram, and distinct values of a bin that are ranked at once.
BINS, FEW = 1024, 1 << 16


def _spread(x: Column) -> Column:
    """A finite number that does not fall where ``x`` rises: its logarithm on
    both sides of zero; infinities and NaN come last, in the order of a sort."""
    near = F.log(F.lit(4.9e-324))  # of the least number above zero
    y = F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) - near + 1))
    return F.when(F.isnan(x), F.lit(2000.0)).otherwise(F.greatest(F.least(y, F.lit(1900.0)), F.lit(-1900.0)))


def _bin(y, lo, hi) -> Column:
    """The number of the bin of ``y`` between ``lo`` and ``hi``; it does not fall where ``y`` rises."""
    share = F.try_divide(F.col(y) - F.col(lo), F.col(hi) - F.col(lo))
    return F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")


def exact_quantiles(df: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """(key, one column per entry of ``qs``): linear interpolation between the
    neighbouring ranks of the non-null values of each group; groups without
    values, and the null group, are left out."""
    from shoplens.session import materialize
    x = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_x"))
    counted = (x.where(F.col("_key").isNotNull() & F.col("_x").isNotNull())
               .groupBy("_key", "_x").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_y", _spread(F.col("_x"))))
    counted = materialize(counted, "counted-values")
    groups = counted.groupBy("_key").agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"), F.sum("_n").alias("_total"),
                                         F.count(F.lit(1)).alias("_few"))
    ranks = F.array_sort(F.array_distinct(F.flatten(F.array(*[
        F.array(f(F.lit(q) * (F.col("_total") - 1)).cast("long")) for q in qs.values() for f in (F.floor, F.ceil)]))))
    # a row per group and wanted bin: bounds of its values, values before it, the ranks in it
    open_ = materialize(groups.select("_key", F.lit(0).alias("_bin"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"),
                                      "_few", ranks.alias("_ranks")), "quantile-bins")
    inside, done = counted.withColumn("_bin", F.lit(0)), []
    small = f"_few <= {FEW} or _lo = _hi"
    while True:
        ready = open_.where(small)
        own = inside.select("_key", "_bin", "_x", "_n").join(ready, ["_key", "_bin"])
        up = F.sum("_n").over(Window.partitionBy("_key", "_bin").orderBy("_x"))  # few values, or one place of the scale
        own = own.withColumn("_to", F.col("_before") + up)
        done.append(own.withColumn("_rank", F.explode("_ranks")).where("_rank < _to and _rank >= _to - _n")
                    .select("_key", "_rank", "_x"))
        open_ = open_.where(f"not ({small})")
        if open_.isEmpty():
            break
        # the next histogram, of the open bins
        inside = inside.select("_key", "_bin", "_x", "_y", "_n").join(
            open_.select("_key", "_bin", "_lo", "_hi"), ["_key", "_bin"]).withColumn("_sub", _bin("_y", "_lo", "_hi"))
        hist = inside.groupBy("_key", "_bin", "_sub").agg(
            F.sum("_n").alias("_own"), F.min("_y").alias("_min"), F.max("_y").alias("_max"), F.count(F.lit(1)).alias("_c"))
        # at most BINS rows of a bin
        up = F.sum("_own").over(Window.partitionBy("_key", "_bin").orderBy("_sub"))
        hist = hist.withColumn("_up", up).join(open_.select("_key", "_bin", "_before", "_ranks"), ["_key", "_bin"])
        hist = hist.withColumn("_first", F.col("_before") + F.col("_up") - F.col("_own")).withColumn(
            "_held", F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_own"))))
        number = F.row_number().over(Window.partitionBy("_key").orderBy("_bin", "_sub"))  # a few of a group
        hist = hist.where(F.size("_held") > 0).withColumn("_new", number)
        open_ = materialize(hist.select("_key", "_bin", "_sub", "_new", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"),
                                        F.col("_first").alias("_before"), F.col("_c").alias("_few"),
                                        F.col("_held").alias("_ranks")), "quantile-bins")
        inside = inside.drop("_lo", "_hi").join(open_.select("_key", "_bin", "_sub", "_new"), ["_key", "_bin", "_sub"])
        inside = materialize(inside.select("_key", F.col("_new").alias("_bin"), "_x", "_y", "_n"), "quantile-values")
        open_ = open_.select("_key", F.col("_new").alias("_bin"), "_lo", "_hi", "_before", "_few", "_ranks")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    # a few ranks of a group
    at = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    at = at.join(groups.select("_key", "_total"), "_key")
    out = []
    for name, q in qs.items():
        place = F.lit(q) * (F.col("_total") - 1)
        a, b = (F.col("_at")[f(place).cast("long")] for f in (F.floor, F.ceil))
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place))).alias(name))
    return at.select(F.col("_key").alias(key), *out)
