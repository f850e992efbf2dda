"""Scalar column expressions (JVM-side, whole-stage codegen friendly).

Every Python callable of the reference (clamp, rates, number parsing,
category splitting, price bins, rating bands ...) becomes one of these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "safe_div", "clamp", "rate_or_count", "number_taker", "split_first",
    "split_rest", "split_pipe", "camel_split", "price_range", "PRICE_BINS",
    "rating_category", "RATING_LEVELS", "star_bar", "truncate_text",
    "count_char", "weekday_mon0", "time_of_day", "half_life_coef", "weekday_name",
    "WEEKDAY_NAMES", "round6",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI division would raise)."""
    return F.try_divide(col_(a), col_(b))


def clamp(x, lo: float, hi: float) -> Column:
    """Clamp keeping null and NaN as they are (least/greatest skip nulls and
    treat NaN as the largest value, which would turn NaN into ``hi``)."""
    x = col_(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(
        F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def rate_or_count(a, b) -> Column:
    """100 * a / b, or 100 * a when b == 0 (the reference's interaction rate)."""
    a, b = col_(a), col_(b)
    return F.lit(100.0) * F.when(b == 0, a.cast("double")).otherwise(safe_div(a, b))


def number_taker(c) -> Column:
    """Concatenate every ``\\d+.\\d+ | \\d+`` run of a dirty money / rating
    string and read it as a double; null when there is none.
    ``'$334,2.99'`` -> 3342.99 (thousand separators vanish, signs are lost)."""
    runs = F.regexp_extract_all(col_(c), F.lit(r"\d+\.\d+|\d+"), 0)
    return _try_double(F.array_join(runs, ""))


def _try_double(c: Column) -> Column:
    return F.when(c == "", F.lit(None).cast("double")).otherwise(c.try_cast("double"))


def split_first(c, sep_regex: str) -> Column:
    """Part before the first separator (whole string when there is none)."""
    return F.get(F.split(col_(c), sep_regex, 2), 0)


def split_rest(c, sep_regex: str) -> Column:
    """Part after the first separator, null when there is none."""
    return F.get(F.split(col_(c), sep_regex, 2), 1)


def split_pipe(c, i: int) -> Column:
    """i-th field of an ``A|B|C`` path, null when missing."""
    return F.get(F.split(col_(c), r"[|]"), i)


def camel_split(c) -> Column:
    """Insert a space before each capital letter or '&':
    ``Computers&Accessories`` -> `` Computers & Accessories``."""
    return F.regexp_replace(col_(c), r"([A-Z&])", " $1")


# Price bins are right-closed (0, 10], (10, 100], (100, 500],
# (500, inf); prices of 0 or below fall in no bin.
PRICE_BINS = [(0.0, 10.0, "0-10 USD"), (10.0, 100.0, "10-100 USD"),
              (100.0, 500.0, "100-500 USD"), (500.0, None, "Above 500 USD")]


def price_range(c) -> Column:
    x = col_(c)
    expr = None
    for lo, hi, label in PRICE_BINS:
        cond = (x > lo) if hi is None else ((x > lo) & (x <= hi))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


# Rating bands, in rank order.
RATING_LEVELS = ["Poor", "Below Average", "Average", "Above Average", "Excellent"]


def rating_category(c) -> Column:
    x = col_(c)
    return (F.when(x < 2.0, "Poor").when(x < 3.0, "Below Average")
            .when(x < 4.0, "Average").when(x < 5.0, "Above Average")
            .when(x == 5.0, "Excellent"))


def star_bar(c) -> Column:
    """Filled stars for int(rating), hollow ones for the rest of five."""
    n = F.least(F.greatest(col_(c).cast("int"), F.lit(0)), F.lit(5))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(5) - n))


def truncate_text(c, n: int = 300) -> Column:
    x = col_(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def count_char(c, ch: str) -> Column:
    x = col_(c)
    return F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(c))


def time_of_day(c) -> Column:
    """``HH:mm:ss`` string (the TIME type is not enabled by default)."""
    return F.date_format(col_(c), "HH:mm:ss")


def half_life_coef(days, weight_decay: float, half_life_days: float) -> Column:
    """exp(ln(w) * days / n): 1 today, w after n days, w^2 after 2n."""
    import math
    return F.exp(F.lit(math.log(weight_decay)) * col_(days).cast("double") / F.lit(float(half_life_days)))


# Weekday names, Monday first.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_name(c) -> Column:
    return F.get(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), col_(c).cast("int"))


def round6(c) -> Column:
    """Snap a double to a 2^-20 (~1e-6) grid with plain IEEE arithmetic,
    floor(x * 2^20 + 0.5) / 2^20, for comparing results across engines.
    A binary grid, unlike a decimal one, has no ties that averages of
    decimal prices land on exactly, so engines whose sums differ only in
    the last bit still produce the same value."""
    return F.floor(col_(c).cast("double") * F.lit(1048576.0) + F.lit(0.5)) / F.lit(1048576.0)
