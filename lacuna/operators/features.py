"""Row-level features from masks, values and intervals: window columns over one partitioning by id, without joins."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.expr import total
from lacuna.operators.panel import Panel

LOCAL = 5


def _rolling(x: Column, w, n: int, agg) -> Column:
    """agg over the last n rows; null until n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def _add(p: Panel, cols: dict[str, Column]) -> Panel:
    return replace(p, df=p.df.drop(*cols).withColumns(cols))


def circular(p: Panel) -> Panel:
    angle = F.hour(p.clock) * (2 * math.pi / 24)
    return _add(p, {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def lag_mask(p: Panel, lag: int = 1, fill: int = 0, cols: list[str] | None = None) -> Panel:
    return _add(p, {f"{c}_mask_lag_{lag}": F.coalesce(F.lag(p.mask(c).cast("int"), lag).over(p.w), F.lit(fill)) for c in cols or p.cols})


def consecutive(p: Panel, cols: list[str] | None = None) -> Panel:
    """Imperfect rows in a row, up to this one: the rows since the last one that is not imperfect."""
    at = F.row_number().over(p.w)
    df = p.df.withColumn("_at", at)
    last_ok = {c: F.coalesce(F.last(F.when(F.coalesce(p.mask(c).cast("int"), F.lit(0)) != 1, F.col("_at")), True).over(p.w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) for c in cols or p.cols}
    return replace(p, df=df.drop(*(f"{c}_mask_consecutive" for c in last_ok)).withColumns({f"{c}_mask_consecutive": (F.col("_at") - v).cast("int") for c, v in last_ok.items()}).drop("_at"))


def time_since(p: Panel, cap: int = 3600, cols: list[str] | None = None) -> Panel:
    """Seconds since the last imperfect, and the last other, row (this one included): 0 if there is none yet, cap at most."""
    out, w = {}, p.w.rowsBetween(W.unboundedPreceding, 0)
    for c in cols or p.cols:
        for name, hit in (("imperfect", p.mask(c) == 1), ("non_imperfect", p.mask(c) == 0)):
            last = F.last(F.when(hit, F.col(p.clock)), True).over(w)
            out[f"{c}_time_since_{name}"] = F.least(F.coalesce(p.seconds(last, F.col(p.clock)), F.lit(0)), F.lit(cap))
    return _add(p, out)


def rolling(p: Panel, sizes: tuple[int, ...] = (5,), fill: bool = True, cols: list[str] | None = None) -> Panel:
    """Sum and sample variance of the mask over the last n rows; null (or 0) until the window is full."""
    out = {}
    for c in cols or p.cols:
        m = p.mask(c).cast("double")
        for n in sizes:
            for name, agg in (("sum", F.sum), ("var", F.var_samp)):
                v = _rolling(m, p.w, n, agg)
                out[f"{c}_mask_rolling_{name}_{n}"] = F.coalesce(v, F.lit(0.0)) if fill else v
    return _add(p, out)


def ewma(p: Panel, alphas: tuple[float, ...] = (0.3,), spans: tuple[float, ...] = (), half_lives: tuple[float, ...] = (), cols: list[str] | None = None) -> Panel:
    """y0 = x0, y = a x + (1 - a) y_before; nulls keep the last y. Half-lives (seconds) decay with the time since the last row.

    Rows are sorted within partitions of whole ids and run through once, so an id's rows need not fit in memory. All columns are made in one pass.
    """
    own = cols or p.cols
    kinds = [(f"{a:g}", "alpha", a) for a in alphas] + [(f"{s:g}", "alpha", 2 / (s + 1)) for s in spans] + [(f"{h:g}", "half", h) for h in half_lives]
    names = [f"{c}_mask_ewma_{k}" for c in own for k, _, _ in kinds]
    df = p.df.drop(*names)
    t = p.micros(F.col(p.clock)).cast("double") / 1e6
    df = df.withColumn("_t", t)
    schema = T.StructType([f for f in df.schema.fields if f.name != "_t"] + [T.StructField(n, T.DoubleType()) for n in names])
    at = [df.columns.index(f"{c}_mask") for c in own]
    i_id, i_t, keep = df.columns.index(p.id), df.columns.index("_t"), [i for i, c in enumerate(df.columns) if c != "_t"]

    def run(batches):
        last_id, state, last_t = object(), {}, None
        for b in batches:
            ids, times = b.column(i_id).to_pylist(), b.column(i_t).to_pylist()
            masks = [b.column(i).to_pylist() for i in at]
            out = np.full((len(names), len(ids)), np.nan)
            for r, (key, now) in enumerate(zip(ids, times)):
                if key != last_id:
                    last_id, state, last_t = key, {}, None
                n = 0
                for m in masks:
                    x = m[r]
                    for _, kind, a in kinds:
                        y = state.get(n)
                        if x is not None:
                            if y is None:
                                y = float(x)
                            else:
                                w = a if kind == "alpha" else 1 - 0.5 ** ((now - last_t) / a)
                                y = w * x + (1 - w) * y
                            state[n] = y
                        if y is not None:
                            out[n, r] = y
                        n += 1
                last_t = now
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array(x, mask=np.isnan(x)) for x in out)], schema=pa.schema([*(b.schema.field(i) for i in keep), *(pa.field(n, pa.float64()) for n in names)]))

    dealt = df.repartition(p.id).sortWithinPartitions(p.id, p.clock, p.clock_no)
    return replace(p, df=dealt.mapInArrow(run, schema))


def interactions(p: Panel, cols: list[str] | None = None) -> Panel:
    """For every ordered pair: value or mask of one, now, times value or mask of the other, one row before."""
    own = [c for c in cols or p.cols if p.is_numeric(c)]
    before = {c: (F.lag(F.col(c).cast("double")).over(p.w), F.lag(p.mask(c).cast("double")).over(p.w)) for c in own}
    df = p.df.withColumns({f"_{k}_{c}": v for c, (a, b) in before.items() for k, v in (("v", a), ("m", b))})
    out = {}
    for a in own:
        for b in own:
            if a != b:
                for now, x in (("value", F.col(a).cast("double")), ("mask", p.mask(a).cast("double"))):
                    for then, y in (("value", F.col(f"_v_{b}")), ("mask", F.col(f"_m_{b}"))):
                        out[f"inter_{a}_{now}_t_{b}_{then}_t-1"] = x * y
    return replace(p, df=df.drop(*out).withColumns(out).drop(*(f"_{k}_{c}" for c in own for k in "vm")))


def row_level(p: Panel) -> Panel:
    return _add(p, {"percentage_imperfect": total(p.masks(), skip_null=True) / len(p.cols)})


def interval(p: Panel) -> Panel:
    """interval_seconds (null in the first row), its z-score within the id (null if constant), the coefficient of variation of the last 5."""
    x = F.col("interval_seconds")
    df = p.df.withColumn("interval_seconds", p.seconds(F.lag(p.clock).over(p.w), F.col(p.clock)).cast("double"))
    whole = W.partitionBy(p.id)
    sd, mean = F.stddev_samp(x).over(whole), F.avg(x).over(whole)
    m, s = _rolling(x, p.w, LOCAL, F.avg), _rolling(x, p.w, LOCAL, F.stddev_samp)
    return replace(p, df=df.withColumns({"interval_z_score": F.when(sd > 0, (x - mean) / F.nullif(sd, F.lit(0.0))), "interval_cv_local": F.when(m > 0, s / F.nullif(m, F.lit(0.0)))}))


def acceleration(p: Panel, n: int = LOCAL) -> Panel:
    """The change of the interval, and its rolling mean, mean of absolute values and standard deviation."""
    seconds = p.seconds(F.lag(p.clock).over(p.w), F.col(p.clock)).cast("double")
    df = p.df.withColumn("_s", seconds)
    df = df.withColumn("interval_acceleration", F.col("_s") - F.lag("_s").over(p.w)).drop("_s")
    a = F.col("interval_acceleration")
    return replace(p, df=df.withColumns({"rolling_mean_acceleration": _rolling(a, p.w, n, F.avg), "rolling_abs_acceleration": _rolling(F.abs(a), p.w, n, F.avg), "rolling_std_acceleration": _rolling(a, p.w, n, F.stddev_samp)}))


class FeatureGenerator:
    """Steps by chaining; each returns self. df holds the result."""

    def __init__(self, panel: Panel):
        self.panel = panel

    @property
    def df(self):
        return self.panel.df

    def _do(self, step, *args, **kwargs) -> "FeatureGenerator":
        self.panel = step(self.panel, *args, **kwargs)
        return self

    def add_circular_features(self):
        return self._do(circular)

    def add_lag_mask(self, lag: int = 1, cols=None):
        return self._do(lag_mask, lag, 0, cols)

    def add_consecutive_counts(self, cols=None):
        return self._do(consecutive, cols)

    def add_time_since(self, cap: int = 3600, cols=None):
        return self._do(time_since, cap, cols)

    def add_rolling_window_features(self, sizes=(5,), cols=None):
        return self._do(rolling, tuple(sizes), True, cols)

    def add_exponential_moving_average(self, alphas=(0.3,), cols=None):
        return self._do(ewma, tuple(alphas), (), (), cols)

    def add_pairwise_interactions(self, cols=None):
        return self._do(interactions, cols)

    def add_row_level_features(self):
        return self._do(row_level)

    def add_interval_features(self):
        return self._do(interval)

    def add_windowed_acceleration(self, n: int = LOCAL):
        return self._do(acceleration, n)

    def generate_all_features(self, rolling_sizes=(2,), ewma_alphas=(0.3, 0.5), cap: int = 3600) -> "FeatureGenerator":
        if not isinstance(self.panel.clock_type, T.NumericType):
            self.add_circular_features()
        self.add_lag_mask().add_consecutive_counts().add_time_since(cap).add_rolling_window_features(rolling_sizes)
        self.add_pairwise_interactions().add_row_level_features().add_interval_features().add_windowed_acceleration()
        return self.add_exponential_moving_average(ewma_alphas)
