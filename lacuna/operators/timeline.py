"""Imperfection over time: transitions, autocorrelation, lagged correlation, calendar distributions."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lacuna.functions.expr import each_row, ratio
from lacuna.functions.seasonal import stl
from lacuna.operators.panel import Panel


def transitions(p: Panel) -> DataFrame:
    """Per variable: n00, n01, n10, n11 of consecutive rows within an id."""
    w = W.partitionBy(p.id, "variable").orderBy(p.clock, p.clock_no)
    pairs = p.long().select("variable", "mask", F.lead("mask").over(w).alias("_next"))
    return pairs.groupBy("variable").agg(*(F.count_if((F.col("mask") == i) & (F.col("_next") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))


def markov(p: Panel) -> DataFrame:
    """Transition probabilities (0 in a row without transitions) and the steady state (null if no transition leaves either)."""
    t = transitions(p)
    prob = lambda i, j: F.coalesce(ratio(F.col(f"n{i}{j}"), F.col(f"n{i}0") + F.col(f"n{i}1")), F.lit(0.0))
    t = t.withColumns({f"p{i}{j}": prob(i, j) for i in (0, 1) for j in (0, 1)})
    return t.withColumns({"steady0": ratio(F.col("p10"), F.col("p01") + F.col("p10")), "steady1": ratio(F.col("p01"), F.col("p01") + F.col("p10"))})


def persistence_per_case(p: Panel, least: int = 10) -> DataFrame:
    """Per (id, variable) P(1 to 1); null for ids with fewer than `least` rows or no transition from 1."""
    w = W.partitionBy(p.id, "variable").orderBy(p.clock, p.clock_no)
    pairs = p.long().select(p.id, "variable", "mask", F.lead("mask").over(w).alias("_next"))
    from1, both = F.count_if((F.col("mask") == 1) & F.col("_next").isNotNull()), F.count_if((F.col("mask") == 1) & (F.col("_next") == 1))
    return pairs.groupBy(p.id, "variable").agg(F.when(F.count(F.lit(1)) >= least, ratio(both, from1)).alias("p11"))


def acf(df: DataFrame, id_col: str, order: list[str], x: str, lags: int = 20, keys: list[str] = ()) -> DataFrame:
    """keys, lag, n_pairs, autocorr: deviations from the global mean over the global variance, pairs within an id. Lags without pairs, or a constant x, give no row."""
    keys = list(keys)
    v = F.col(x).cast("double")
    stats = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.avg(v).alias("_m"), F.var_samp(v).alias("_v"))
    w = W.partitionBy(*keys, id_col).orderBy(*order)
    lagged = df.select(*keys, v.alias("_x"), *(F.lag(v, k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)))
    joined = lagged.join(stats, keys) if keys else lagged.crossJoin(F.broadcast(stats))  # one row
    aggs = []
    for k in range(1, lags + 1):
        both = F.col("_x").isNotNull() & F.col(f"_l{k}").isNotNull()
        aggs.append(F.struct(F.lit(k).alias("lag"), F.count_if(both).alias("n_pairs"), F.sum((F.col("_x") - F.col("_m")) * (F.col(f"_l{k}") - F.col("_m"))).alias("s")))
    out = joined.groupBy(*keys, "_v").agg(F.explode(F.array(*aggs)).alias("r")).where("_v > 0 and r.n_pairs > 0")
    return out.select(*keys, "r.lag", "r.n_pairs", (F.col("r.s") / F.nullif(F.col("_v") * F.col("r.n_pairs"), F.lit(0.0))).alias("autocorr"))


def decomposed(found: DataFrame, keys: list[str], period: int, robust: bool = True) -> DataFrame:
    """keys, lag, trend, seasonal, remainder of autocorrelations: one short series a key, as long as its lags. Keys with fewer than two whole periods give no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        if len(pdf) < 2 * period:
            return pdf[[*keys, "lag"]].head(0).assign(trend=0.0, seasonal=0.0, remainder=0.0)
        trend, seasonal, remainder = stl(pdf["autocorr"], period, robust=robust)
        return pdf[[*keys, "lag"]].assign(trend=trend, seasonal=seasonal, remainder=remainder)

    if period < 2:
        raise ValueError("a period has at least 2 lags")
    rows = found.select(*keys, "lag", "autocorr")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, trend double, seasonal double, remainder double")


def acf_masks(p: Panel, lags: int = 20) -> DataFrame:
    return acf(p.long(), p.id, [p.clock, p.clock_no], "mask", lags, ["variable"])


def acf_values(p: Panel, lags: int = 20) -> DataFrame:
    return acf(p.long(p.numeric()), p.id, [p.clock, p.clock_no], "value", lags, ["variable"])


def _correlation(x: Column, y: Column) -> Column:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def lagged_cross_correlation(p: Panel, lags: int = 10) -> DataFrame:
    """x, y, lag, correlation of x(t) with y(t - lag) within an id, for every ordered pair of masks: unordered pairs are computed, the others mirrored."""
    cells, lagged = [], {}
    for a, b in combinations(p.cols, 2):
        for k in range(-lags, lags + 1):
            name = f"_{b}_{k}"
            lagged[name] = F.lag(p.mask(b).cast("int"), k).over(p.w) if k >= 0 else F.lead(p.mask(b).cast("int"), -k).over(p.w)
            cells.append((a, b, k, name))
    rows = p.df.select(*(p.mask(c).cast("int").alias(f"_m_{c}") for c in p.cols), *(v.alias(n) for n, v in lagged.items()))
    each = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(k).alias("lag"), _correlation(F.col(f"_m_{a}"), F.col(n)).alias("correlation")) for a, b, k, n in cells]
    own = rows.agg(each_row(each, "x string, y string, lag int, correlation double").alias("s")).select("s.*")
    return own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"), (-F.col("lag")).alias("lag"), "correlation"))


def phi_matrix(p: Panel) -> DataFrame:
    """x, y, phi for all ordered pairs, 1 on the diagonal, 0 where a mask is constant."""
    each = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.coalesce(_correlation(p.mask(a).cast("int"), p.mask(b).cast("int")), F.lit(0.0)).alias("phi")) for a, b in combinations(p.cols, 2)]
    own = p.df.agg(each_row(each, "x string, y string, phi double").alias("s")).select("s.*")
    same = p.df.limit(1).select(F.explode(F.array(*(F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("phi")) for c in p.cols))).alias("s")).select("s.*")
    return own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"), "phi")).unionByName(same)


def calendar(p: Panel, part: str) -> DataFrame:
    """Per variable and month, weekday (Monday 1) or hour: share and count of imperfect rows."""
    of = {"month": F.month(p.clock), "weekday": F.weekday(p.clock) + 1, "hour": F.hour(p.clock)}[part]
    return p.long().groupBy("variable", of.cast("int").alias(part)).agg(F.avg("mask").alias("indicated_share"), F.sum("mask").alias("indicated_count"), F.count(F.lit(1)).alias("n"))


def month_hour_grid(p: Panel) -> DataFrame:
    """Every month and hour for every variable; cells without rows count as 1.0 with n = 0."""
    own = p.long().groupBy("variable", F.month(p.clock).alias("month"), F.hour(p.clock).alias("hour")).agg(F.avg("mask").alias("indicated_share"), F.count(F.lit(1)).alias("n"))
    spark = p.df.sparkSession
    grid = spark.range(len(p.cols) * 12 * 24).select(F.element_at(F.array(*map(F.lit, p.cols)), (F.col("id") / 288).cast("int") + 1).alias("variable"), ((F.col("id") / 24).cast("int") % 12 + 1).alias("month"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(own, ["variable", "month", "hour"], "left").select("variable", "month", "hour", F.coalesce("indicated_share", F.lit(1.0)).alias("indicated_share"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
