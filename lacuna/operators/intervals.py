"""How regular the observation grid is: statistics of the time between observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.expr import burstiness, half_even, nearest_quantile, ratio, sorted_sum
from lacuna.functions.order import quantiles
from lacuna.operators.panel import Panel

BIN_SECONDS, TOLERANCE = 60.0, 0.5
#: Modes: the pooled mode takes the smallest of equally frequent bins, a case's mode the largest.
SMALLEST, LARGEST = "smallest", "largest"


def intervals(p: Panel) -> DataFrame:
    """The panel's rows with interval_seconds since the previous row of the id; rows without one, or with 0 or less, go."""
    before = F.lag(p.clock).over(p.w)
    return p.df.withColumn("interval_seconds", p.seconds(before, F.col(p.clock))).where("interval_seconds > 0")


def case_statistics(iv: DataFrame, id_col: str, x: str = "interval_seconds") -> DataFrame:
    q25, q75 = nearest_quantile(F.col(x), 0.25), nearest_quantile(F.col(x), 0.75)
    agg = iv.groupBy(id_col).agg(
        F.count(x).alias("n_intervals"), F.avg(x).alias("mean_interval"), F.median(x).alias("median_interval"), F.stddev_samp(x).alias("std_interval"),
        ratio(F.stddev_samp(x), F.avg(x)).alias("interval_cv"), q25.cast("double").alias("_q1"), q75.cast("double").alias("_q3"), F.min(x).alias("min_interval"), F.max(x).alias("max_interval"),
    )
    return agg.withColumns({"interval_iqr": F.col("_q3") - F.col("_q1"), "interval_qcod": ratio(F.col("_q3") - F.col("_q1"), F.col("_q3") + F.col("_q1"))}).drop("_q1", "_q3")


def describe(df: DataFrame, keys: list[str], x: str, n_rows: Column | None = None) -> DataFrame:
    """count, null_count, mean, std, min, 25 %, 50 %, 75 % (linear) and max."""
    v = F.col(x).cast("double")
    base = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, keys, x, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    out = base.join(q, keys, "left") if keys else base.crossJoin(F.broadcast(q))  # one row each
    return out.select(*keys, "count", "null_count", "mean", "std", "min", "p25", "p50", "p75", "max")


def bin_of(x: Column, size: float) -> Column:
    return half_even(x.cast("double") / size).cast("bigint")


def bins(iv: DataFrame, size: float = BIN_SECONDS, keys: list[str] = (), x: str = "interval_seconds") -> DataFrame:
    """keys, bin, count."""
    return iv.where(F.col(x).isNotNull()).groupBy(*keys, bin_of(F.col(x), size).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def _shape(binned: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """keys, mode, n, n_bins, top, entropy (bits): from the bins of each key."""
    n = F.sum("count").over(W.partitionBy(*keys)) if keys else None
    if keys:
        binned = binned.withColumn("n", n)
    else:
        binned = binned.crossJoin(F.broadcast(binned.agg(F.sum("count").alias("n"))))
    share = F.col("count") / F.col("n")
    order = F.struct("count", (-F.col("bin")).alias("b")) if tie == SMALLEST else F.struct("count", F.col("bin").alias("b"))
    g = binned.groupBy(*keys) if keys else binned.groupBy()
    return g.agg(F.max_by("bin", order).alias("mode"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_bins"), F.max("count").alias("top"), sorted_sum(-share * F.log2(share)).alias("entropy"))


def _normalised(entropy: Column, n_bins: Column) -> Column:
    return F.when(n_bins <= 1, 0.0).otherwise(entropy / F.nullif(F.log2(n_bins.cast("double")), F.lit(0.0)))


def dominant_frequency(iv: DataFrame, size: float = BIN_SECONDS, tolerance: float = TOLERANCE, keys: list[str] = (), x: str = "interval_seconds") -> DataFrame:
    """The pooled mode bin and how closely intervals keep to it; one row, or one per key."""
    keys = list(keys)
    shape = _shape(bins(iv, size, keys, x), keys, SMALLEST)
    rows = iv.where(F.col(x).isNotNull()).select(*keys, x)
    joined = rows.join(shape, keys) if keys else rows.crossJoin(F.broadcast(shape))  # one row
    m = F.col("mode") * size
    g = joined.groupBy(*keys) if keys else joined.groupBy()
    out = g.agg(
        F.first("n").alias("n_intervals"), F.first(m).alias("dominant_interval_seconds"), F.first("top").alias("dominant_count"), F.first("n_bins").alias("n_bins"), F.first("entropy").alias("entropy"),
        F.avg(F.col(x).between(m * (1 - tolerance), m * (1 + tolerance)).cast("double")).alias("adherence_rate"), F.first("mode").alias("mode"),
    ).where("n_intervals is not null")
    return out.select(
        *keys, "n_intervals", "dominant_interval_seconds", F.when(F.col("dominant_interval_seconds") > 0, 1 / F.nullif("dominant_interval_seconds", F.lit(0.0))).alias("dominant_frequency_hz"),
        "dominant_count", (F.col("dominant_count") / F.col("n_intervals")).alias("dominant_share"), "n_bins", "adherence_rate", "entropy", _normalised(F.col("entropy"), F.col("n_bins")).alias("normalized_entropy"), F.lit(float(size)).alias("bin_resolution_seconds"),
    )


def entropy_adherence(iv: DataFrame, keys: list[str], size: float = BIN_SECONDS, tolerance: float = TOLERANCE, least: int = 2, x: str = "interval_seconds", names: tuple[str, str] = ("interval_entropy", "interval_adh_rate")) -> DataFrame:
    """Per case: normalised entropy of its bins and adherence to its own mode; null below `least` intervals."""
    keys = list(keys)
    rows = iv.where(F.col(x).isNotNull()).select(*keys, x)
    shape = _shape(bins(rows, size, keys, x), keys, LARGEST)
    m = F.col("mode") * size
    kept = rows.join(shape.select(*keys, "mode", "n", "n_bins", "entropy"), keys).groupBy(*keys, "mode", "n", "n_bins", "entropy").agg(F.avg(F.col(x).between(m * (1 - tolerance), m * (1 + tolerance)).cast("double")).alias("_adh"))
    enough = F.col("n") >= least
    return kept.select(*keys, F.col("n").alias("n_intervals"), F.when(enough, m).alias("dominant_interval_seconds"), F.when(enough, _normalised(F.col("entropy"), F.col("n_bins"))).alias(names[0]), F.when(enough, F.col("_adh")).alias(names[1]))


def burstiness_case(iv: DataFrame, id_col: str, least: int = 3, x: str = "interval_seconds") -> DataFrame:
    return iv.groupBy(id_col).agg(F.count(x).alias("n_intervals"), F.avg(x).alias("mean_interval"), F.stddev_samp(x).alias("std_interval"), burstiness(F.col(x), least).alias("burstiness"))


def burstiness_pooled(iv: DataFrame, id_col: str, least: int = 3, x: str = "interval_seconds") -> DataFrame:
    """Over the intervals of ids with at least `least` of them."""
    per_id = W.partitionBy(id_col)
    rows = iv.withColumn("_n", F.count(x).over(per_id)).where(F.col("_n") >= least)
    return rows.agg(F.count(x).alias("n_intervals"), F.avg(x).alias("mean_interval"), F.stddev_samp(x).alias("std_interval"), burstiness(F.col(x), 1).alias("burstiness"))


def case_metrics(iv: DataFrame, id_col: str, size: float = BIN_SECONDS, tolerance: float = TOLERANCE, least: int = 2) -> DataFrame:
    """interval_cv, interval_qcod, interval_adh_rate, interval_entropy per id."""
    stats = case_statistics(iv, id_col).select(id_col, "interval_cv", "interval_qcod")
    return stats.join(entropy_adherence(iv, [id_col], size, tolerance, least).select(id_col, "interval_adh_rate", "interval_entropy"), id_col, "left")
