"""What the observed values look like: descriptions, correlations, per-case metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.expr import each_row, ratio
from lacuna.functions.order import average_ranks, quantiles
from lacuna.functions.rankpairs import rank_correlations as paired_ranks
from lacuna.operators.panel import Panel
from lacuna.operators.timeline import _correlation

#: Decimal digits in which values are compared for rank correlations.
DIGITS = 12
UNIT_SECONDS = {"second": 1, "minute": 60, "half-hour": 1800, "hour": 3600, "day": 86400}


def describe(p: Panel) -> DataFrame:
    """Per variable: count, null_count, mean, std, min, percentiles 5, 25, 50, 75, 95, max."""
    long, v = p.long(p.numeric()), F.col("value")
    base = long.groupBy("variable").agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(long, ["variable"], "value", {f"p{k:02d}": k / 100 for k in (5, 25, 50, 75, 95)})
    return base.join(q, "variable", "left").select("variable", "count", "null_count", "mean", "std", "min", "p05", "p25", "p50", "p75", "p95", "max")


def histogram(p: Panel, bins: int = 20) -> DataFrame:
    """variable, bin (from 0), low, high, n: bins of equal width between the variable's extremes; empty bins give no row, a constant variable one of no width."""
    long = p.long(p.numeric()).where("value is not null and not isnan(value)").select("variable", "value")
    ends = long.groupBy("variable").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_a")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    n = long.join(ends, "variable").groupBy("variable", "_a", "_b", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("variable", "bin", (F.col("_a") + F.col("bin") * width).alias("low"), (F.col("_a") + (F.col("bin") + 1) * width).alias("high"), "n")


def _mirrored(own: DataFrame, value: str) -> DataFrame:
    return own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"), *[c for c in own.columns if c not in ("x", "y")]))


def correlation_listwise(p: Panel) -> DataFrame:
    """Pearson over rows where all numeric variables are observed: x, y, n, correlation."""
    cols = p.numeric()
    rows = p.df.dropna(subset=cols)
    each = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count(F.lit(1)).alias("n"), _correlation(F.col(a), F.col(b)).alias("correlation")) for a, b in combinations(cols, 2)]
    return _mirrored(rows.agg(each_row(each, "x string, y string, n bigint, correlation double").alias("s")).select("s.*"), "correlation")


def leading(v: Column, digits: int = DIGITS) -> Column:
    """v with its leading decimal digits only (below 1e-250 all of it)."""
    up = F.pow(F.lit(10.0), (digits - 1 - F.floor(F.log10(F.abs(v)))).cast("double"))
    return F.when((F.abs(v) < 1e-250) | F.isnan(v) | (F.abs(v) == float("inf")), v + F.lit(0.0)).otherwise(F.rint(v * up) / F.nullif(up, F.lit(0.0)))


def spearman(pairs: DataFrame, keys: list[str], x: str = "vx", y: str = "vy") -> DataFrame:
    """keys, n, correlation: average ranks over the complete pairs of each key, then Pearson; null if a side is constant or n < 3.

    Values that agree in their DIGITS leading decimal digits tie, whatever their scale, so that sums taken in another order do not change ranks.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = pairs.select(*keys, leading(F.col(x).cast("double")).alias("vx"), leading(F.col(y).cast("double")).alias("vy")).where(ok("vx") & ok("vy"))
    rx = average_ranks(rows, keys, "vx").select(*keys, "vx", F.col("rank").alias("rx"))
    ry = average_ranks(rows, keys, "vy").select(*keys, "vy", F.col("rank").alias("ry"))
    counted = rows.groupBy(*keys, "vx", "vy").agg(F.count(F.lit(1)).alias("c"))  # equal pairs once
    j = counted.join(rx, [*keys, "vx"]).join(ry, [*keys, "vy"])
    c, mid = F.col("c"), (F.sum("c") + 1) / 2
    sxy, sxx, syy = F.sum(c * F.col("rx") * F.col("ry")), F.sum(c * F.col("rx") * F.col("rx")), F.sum(c * F.col("ry") * F.col("ry"))
    n = F.sum(c)
    cov, vx, vy = sxy - n * mid * mid, sxx - n * mid * mid, syy - n * mid * mid
    return j.groupBy(*keys).agg(n.alias("n"), F.when((n >= 3) & (vx > 1e-9) & (vy > 1e-9), cov / F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))), F.lit(0.0))).alias("correlation"))


def rank_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, int, float | None]]:
    """(x, y, n, correlation) of pairs of columns with complete rows, as `spearman` has them, without a row for each pair."""
    cols = list(dict.fromkeys(c for xy in pairs for c in xy))
    wide = df.select(*(leading(F.col(f"`{c}`").cast("double")).alias(f"_{i}") for i, c in enumerate(cols)))
    found = paired_ranks(wide, [(cols.index(x), cols.index(y)) for x, y in pairs])
    return [(x, y, n, rho) for (x, y), (n, rho) in zip(pairs, found) if n]


def correlation_pairwise(p: Panel) -> DataFrame:
    """Spearman over each pair's complete rows: x, y, n, correlation."""
    own = rank_correlations(p.df, list(combinations(p.numeric(), 2)))
    return _mirrored(p.df.sparkSession.createDataFrame(own, "x string, y string, n bigint, correlation double"), "correlation")


def case_metrics(p: Panel, least_spread: int = 2, least_slope: int = 2, unit: str = "hour") -> DataFrame:
    """Per (id, variable) over observed values: mean, min, max, iqr, OLS slope per unit (per clock_no if the clock is a number), first by clock."""
    long, v = p.long(p.numeric()), F.col("value")
    if isinstance(p.clock_type, T.NumericType):
        t = F.col(p.clock_no).cast("double")
    else:
        t = p.micros(F.col(p.clock)) / (UNIT_SECONDS[unit] * 1_000_000.0)
    # times from the case's start: raw epochs would lose digits in the sums
    start = p.df.groupBy(p.id).agg(F.min(p.clock).alias("_t0"))
    if not isinstance(p.clock_type, T.NumericType):
        long = long.join(start, p.id).withColumn("_t", p.micros(F.col(p.clock)) / (UNIT_SECONDS[unit] * 1_000_000.0) - p.micros(F.col("_t0")) / (UNIT_SECONDS[unit] * 1_000_000.0))
    else:
        long = long.withColumn("_t", t)
    x = F.when(v.isNotNull(), F.col("_t"))
    n = F.count(v)
    slope = F.when((n >= least_slope) & (F.var_samp(x) > 0), F.covar_samp(x, v) / F.nullif(F.var_samp(x), F.lit(0.0)))
    return long.groupBy(p.id, "variable").agg(
        F.avg(v).alias("value_mean"), F.min(v).alias("value_min"), F.max(v).alias("value_max"), F.when(n >= least_spread, F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("value_iqr"), slope.alias("value_slope"),
        F.min_by(v, F.when(v.isNotNull(), F.struct(p.clock, p.clock_no))).alias("value_first"),
    )


def fisher_interval(rho: Column, n: Column, z: float) -> tuple[Column, Column]:
    """For Spearman's rho: standard error sqrt(1.06 / (n - 3)); null if n < 4 or |rho| is 1 or more."""
    ok = (n >= 4) & (F.abs(rho) < 1)
    safe = F.when(ok, rho)
    reach = z * F.sqrt(1.06 / F.when(ok, (n - 3).cast("double")))
    return F.tanh(F.atanh(safe) - reach), F.tanh(F.atanh(safe) + reach)
