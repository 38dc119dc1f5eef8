"""Runs between observed values of a variable: gaps, what follows them, and per-case gap metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.expr import burstiness, ratio
from lacuna.functions.order import quantiles
from lacuna.operators import intervals as I
from lacuna.operators.panel import Panel


def runs(p: Panel) -> DataFrame:
    """From each observed (mask 0) row of a variable to its next: id, variable, count_clock_no (0: adjacent), time_length, run_start_clock,
    run_end_clock, return_value. What lies before the first and after the last observed row is no run."""
    w = W.partitionBy(p.id, "variable").orderBy(p.clock, p.clock_no)
    seen = p.long().where("mask = 0")
    before = seen.select(p.id, "variable", p.clock, p.clock_no, "value", F.lag(p.clock).over(w).alias("_c"), F.lag(p.clock_no).over(w).alias("_n"))
    length = p.seconds(F.col("_c"), F.col(p.clock))
    out = before.where("_n is not null").select(
        p.id, "variable", (F.col(p.clock_no) - F.col("_n") - 1).cast("bigint").alias("count_clock_no"), F.nullif(length, F.lit(0).cast(before.select(length.alias("x")).schema["x"].dataType)).alias("time_length"),
        F.col("_c").alias("run_start_clock"), F.col(p.clock).alias("run_end_clock"), F.col("value").alias("return_value"),
    )
    return out


def true_gaps(r: DataFrame) -> DataFrame:
    return r.where("count_clock_no > 0")


def describe_gaps(r: DataFrame) -> DataFrame:
    return I.describe(true_gaps(r), ["variable"], "time_length")


def dominant_gap(r: DataFrame, size: float = I.BIN_SECONDS, tolerance: float = I.TOLERANCE) -> DataFrame:
    return I.dominant_frequency(true_gaps(r), size, tolerance, ["variable"], "time_length")


def gap_burstiness(r: DataFrame) -> DataFrame:
    x = F.col("time_length")
    return true_gaps(r).groupBy("variable").agg(F.count(x).alias("n_gaps"), F.avg(x).alias("mean_gap"), F.stddev_samp(x).alias("std_gap"), burstiness(x, 1).alias("burstiness"))


def gap_returns(r: DataFrame, id_col: str) -> DataFrame:
    """The value that ends each run."""
    return r.select(id_col, "variable", "count_clock_no", "time_length", "run_end_clock", "return_value")


def return_bins(r: DataFrame, edges: int = 8) -> DataFrame:
    """Runs with their bin of time_length: (lo, hi] between distinct octiles (nearest element) over all runs of the variable; bin 0 lies below the first."""
    own = r.where("time_length is not null and return_value is not null")
    names = [f"_e{i}" for i in range(1, edges)]
    kind = r.schema["time_length"].dataType
    cuts = quantiles(r, ["variable"], "time_length", {n: i / edges for i, n in enumerate(names, 1)}, nearest=True).select("variable", F.array_sort(F.array_distinct(F.array(*(F.col(n).cast(kind) for n in names)))).alias("_cuts"))
    joined = own.join(cuts, "variable")
    at = F.size(F.filter("_cuts", lambda c: c < F.col("time_length")))
    lo, hi = F.when(at == 0, F.lit("-inf")).otherwise(F.get("_cuts", at - 1).cast("string")), F.coalesce(F.get("_cuts", at).cast("string"), F.lit("inf"))
    return joined.select(*[c for c in own.columns], at.cast("bigint").alias("bin"), F.concat(F.lit("("), lo, F.lit(", "), hi, F.lit("]")).alias("label"))


def return_bin_statistics(r: DataFrame, edges: int = 8) -> DataFrame:
    v, keys, rows = F.col("return_value"), ["variable", "bin", "label"], return_bins(r, edges)
    told = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    return told.join(quantiles(rows, keys, "return_value", {"median": 0.5}), keys, "left").select(*keys, "n", "mean", "sd", "median", "min", "max")


def case_gap_metrics(p: Panel, r: DataFrame, size: float = I.BIN_SECONDS, tolerance: float = I.TOLERANCE, least_onset: int = 3) -> DataFrame:
    """Per (id, variable) with at least one run."""
    keys = [p.id, "variable"]
    g, x = true_gaps(r), F.col("time_length").cast("double")
    q1, q3 = F.percentile(x, 0.25), F.percentile(x, 0.75)
    n = F.count(x)
    stats = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.when(n >= 2, ratio(F.stddev_samp(x), F.avg(x))).alias("gap_cv"), F.when(n >= 4, ratio(q3 - q1, q3 + q1)).alias("gap_qcod"), burstiness(x, 3).alias("gap_burstiness_coeff"), F.max(x).alias("_longest"),
    )
    shape = I.entropy_adherence(g, keys, size, tolerance, 1, "time_length", ("gap_normalized_entropy", "gap_adherence_rate")).select(*keys, "gap_normalized_entropy", "gap_adherence_rate")
    w = W.partitionBy(*keys).orderBy("run_start_clock")
    between = p.seconds(F.lag("run_start_clock").over(w), F.col("run_start_clock"))
    onset = g.select(*keys, between.alias("_o")).where("_o > 0").groupBy(*keys).agg(F.when(F.count("_o") >= least_onset - 1, ratio(F.stddev_samp("_o"), F.avg("_o"))).alias("gap_onset_cv"))
    span = p.df.groupBy(p.id).agg(F.min(p.clock).alias("_t0"), F.max(p.clock).alias("_t1"))
    long = p.long().where("mask = 1").join(span, p.id)
    whole = p.seconds(F.col("_t0"), F.col("_t1"))
    centre = long.groupBy(*keys).agg(F.avg(ratio(p.seconds(F.col("_t0"), F.col(p.clock)), whole)).alias("gap_missing_centroid"))
    longest = span.select(p.id, whole.cast("double").alias("_span"))
    base = r.select(*keys).distinct().join(longest, p.id)
    out = reduce(lambda a, b: a.join(b, keys, "left"), [stats, shape, onset, centre], base)
    return out.select(*keys, F.coalesce("n_gaps", F.lit(0)).cast("bigint").alias("n_gaps"), "gap_cv", "gap_qcod", "gap_burstiness_coeff", "gap_normalized_entropy", "gap_adherence_rate", ratio(F.col("_longest"), F.col("_span")).alias("max_gap_fraction"), "gap_onset_cv", "gap_missing_centroid")


def case_metrics(p: Panel, r: DataFrame, size: float = I.BIN_SECONDS, tolerance: float = I.TOLERANCE) -> DataFrame:
    """Per (id, variable): indicated_pct, indicated_centroid, gap_adh_rate, gap_entropy."""
    keys = [p.id, "variable"]
    share = p.long().groupBy(*keys).agg((F.coalesce(F.sum("mask"), F.lit(0)) * 100 / F.count(F.lit(1))).alias("indicated_pct"))
    m = case_gap_metrics(p, r, size, tolerance).select(*keys, F.col("gap_missing_centroid").alias("indicated_centroid"), F.col("gap_adherence_rate").alias("gap_adh_rate"), F.col("gap_normalized_entropy").alias("gap_entropy"))
    return share.join(m, keys, "left")
