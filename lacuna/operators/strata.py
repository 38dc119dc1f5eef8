"""Orthogonal axis stratification: choose the two least correlated axes, cut them at their medians, label the quadrants."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.order import quantiles
from lacuna.operators.values import rank_correlations
from lacuna.sources.store import stored

COMPLETE, ALPHA, BETA, GAMMA, DELTA = "Q_complete", "Q_alpha", "Q_beta", "Q_gamma", "Q_delta"
#: Metrics whose low values mean high imperfection.
INVERTED = ("interval_adh_rate", "gap_adh_rate")


def is_inverted(axis: str, inverted: tuple[str, ...] = INVERTED) -> bool:
    return any(axis == x or axis.endswith(f"_{x}") for x in inverted)


@dataclass(frozen=True)
class Axes:
    """A fit: two axes, their thresholds and where they come from. Thresholds may be given by the caller, as in cross-validation."""

    x: str | None
    y: str | None
    x_threshold: float | None
    y_threshold: float | None
    correlation: float | None = None
    n: int | None = None

    def transform(self, df: DataFrame, complete: Column | None = None, inverted: tuple[str, ...] = INVERTED, prefix: str = "") -> DataFrame:
        """Adds the stratum and five columns of provenance."""
        stratum = assign(self.x, self.y, self.x_threshold, self.y_threshold, complete, inverted) if self.x and self.x_threshold is not None else F.lit(None).cast("string")
        meta = {"axis_x": (self.x, "string"), "axis_y": (self.y, "string"), "threshold_x": (self.x_threshold, "double"), "threshold_y": (self.y_threshold, "double"), "axis_correlation": (self.correlation, "double")}
        return df.withColumn(f"{prefix}stratum", stratum).withColumns({f"{prefix}{k}": F.lit(v).cast(t) for k, (v, t) in meta.items()})


def assign(x: str, y: str, x_threshold, y_threshold, complete: Column | None = None, inverted: tuple[str, ...] = INVERTED) -> Column:
    """Complete cases first; null where an axis is; high is above the median, for inverted axes at or below it."""
    high = lambda c, t: F.col(c) <= t if is_inverted(c, inverted) else F.col(c) > t
    hx, hy = high(x, x_threshold), high(y, y_threshold)
    out = F.when(F.col(x).isNull() | F.col(y).isNull(), None).when(~hx & ~hy, ALPHA).when(hx & ~hy, BETA).when(~hx & hy, GAMMA).otherwise(DELTA)
    return out if complete is None else F.when(complete, COMPLETE).otherwise(out)


def axis_correlations(df: DataFrame, axes: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """x, y, n, correlation, abs_corr of every pair (Spearman over complete rows), least correlated first."""
    own = list(combinations(axes, 2))
    if pairs is not None:
        wanted = {frozenset(x) for x in pairs}
        own = [x for x in own if frozenset(x) in wanted]
    out = df.sparkSession.createDataFrame(rank_correlations(df, own), "x string, y string, n bigint, correlation double")
    return out.withColumn("abs_corr", F.abs("correlation")).orderBy(F.asc_nulls_last("abs_corr"), F.desc("n"), "x", "y")


def discriminating(df: DataFrame, axes: list[str], least: int = 3, most_at_median: float = 0.5) -> list[str]:
    """Axes with at least `least` values of which at most half equal the median."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v")) for a in axes))).alias("s")).select("s.*").where("v is not null")
    med = quantiles(long, ["axis"], "v", {"m": 0.5})
    rows = long.join(F.broadcast(med), "axis").groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") == F.col("m")).cast("double")).alias("s")).collect()  # one row per axis
    ok = {r["axis"] for r in rows if r["n"] >= least and r["s"] is not None and r["s"] <= most_at_median}
    return [a for a in axes if a in ok]


def fit(df: DataFrame, axes: list[str], fallback: tuple[str, str], pairs: list[tuple[str, str]] | None = None, only_discriminating: bool = False) -> Axes:
    """Two small actions: the pair table and two medians, over a stored table of the axes: sums taken again in another order could move values between them."""
    df = stored(df.select(*(F.col(c) for c in dict.fromkeys([*axes, *fallback]) if c in df.columns)), "axes")
    own = discriminating(df, axes) if only_discriminating else list(axes)
    best = axis_correlations(df, own, pairs).where("correlation is not null").limit(1).collect() if len(own) > 1 else []
    if best:
        x, y, corr, n = (best[0][c] for c in ("x", "y", "correlation", "n"))
        if axes.index(x) > axes.index(y):
            x, y = y, x
    else:
        warnings.warn(f"no pair of axes has a defined correlation; falling back to {fallback}")
        (x, y), corr, n = fallback, None, None
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if rows.limit(2).count() < 2:
        return Axes(None, None, None, None)
    tx, ty = (quantiles(rows.select(F.col(c).cast("double").alias("v")), [], "v", {"m": 0.5}).collect()[0]["m"] for c in (x, y))
    return Axes(x, y, tx, ty, corr, n)


def fit_and_stratify(df: DataFrame, axes: list[str], fallback: tuple[str, str], assign_fn=None, **options) -> DataFrame:
    """Fit, then the stratum of each case; assign_fn(df, axes) may give its own column in place of the quadrants."""
    found = fit(df, axes, fallback, **options)
    out = found.transform(df)
    return out if assign_fn is None else out.withColumn("stratum", assign_fn(df, found))


def same_metric_pairs(columns: list[str], variables: list[str], metrics: list[str]) -> list[tuple[str, str]]:
    """Pairs of the same metric for two variables."""
    have = set(columns)
    return [(f"{a}_{m}", f"{b}_{m}") for m in metrics for a, b in combinations(variables, 2) if f"{a}_{m}" in have and f"{b}_{m}" in have]
