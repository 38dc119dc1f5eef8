"""Column expressions with the null, tie and threshold rules that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dbl(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null (ANSI mode throws otherwise)."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def total(cols: list[Column], skip_null: bool = False) -> Column:
    """Sum of columns; a null makes it null unless skipped."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) if skip_null else c for c in cols])


def seconds_between(data_type: T.DataType, before: Column, after: Column) -> Column:
    """after - before. Timestamps: whole seconds, truncated; dates: seconds; numbers: as they are."""
    if isinstance(data_type, T.DateType):
        before, after = before.cast("timestamp_ntz"), after.cast("timestamp_ntz")
    elif isinstance(data_type, T.NumericType):
        return after - before
    return (after - before).cast("bigint")


def epoch_micros(data_type: T.DataType, clock: Column) -> Column:
    """Microseconds since 1970 (numbers: millionths of their unit), for ranges around a time."""
    if isinstance(data_type, T.NumericType):
        return (clock.cast("double") * 1_000_000).cast("bigint")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(clock)
    ntz = clock.cast("timestamp_ntz")
    days = F.datediff(F.to_date(ntz), F.lit("1970-01-01").cast("date")).cast("bigint")
    within = F.hour(ntz) * 3600 + F.minute(ntz) * 60
    return days * 86_400_000_000 + within.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), ntz) * 1_000_000).cast("bigint")


def nearest_quantile(x: Column, q: float) -> Column:
    """Aggregate: the element at round-half-up((n - 1) q) of the sorted values."""
    values = F.array_sort(F.collect_list(x))
    at = F.floor((F.size(values) - 1) * q + 0.5).cast("int")
    return F.get(values, at)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once (products and sums with their errors, after Dekker and Knuth); very large values twice."""
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    ah, bh, p = split(a), split(b), a * b
    al, bl = a - ah, b - bh
    off = al * bl - (((p - ah * bh) - al * bh) - ah * bl)
    s = p + c
    own = s - p
    return F.when((F.abs(a) < 1e290) & (F.abs(c) < 1e290), s + ((p - (s - own)) + (c - own) + off)).otherwise(s)


def sorted_sum(x: Column) -> Column:
    """Aggregate: a sum whose order, and so its rounding, does not depend on partitioning."""
    return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda a, b: a + b)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate over pairs without nulls; null if either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sd = F.stddev_samp(x) * F.stddev_samp(y)
    return F.covar_samp(x, y) / F.nullif(sd, F.lit(0.0))


def burstiness(x: Column, least: int = 3) -> Column:
    """Aggregate (sd - mean) / (sd + mean); null below `least` values."""
    sd, mean = F.stddev_samp(x), F.avg(x)
    return F.when(F.count(x) >= least, ratio(sd - mean, sd + mean))


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def each_row(structs: list[Column], fields: str) -> Column:
    """One row per struct; none where the list is empty, as pairs of a single variable are."""
    return F.explode(F.array(*structs) if structs else F.array().cast(f"array<struct<{fields}>>"))
