"""Imperfection masks: 1 imperfect, 0 fine, null unknown; columns {variable}_mask on the panel's rows."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.order import quantiles
from lacuna.operators.panel import Panel

#: Scales the median absolute deviation to a standard deviation (Iglewicz and Hoaglin 1993).
MAD_SCALE = 0.6745


def missingness(p: Panel) -> Panel:
    """1 where the value is null; NaN is a value."""
    return replace(p, df=p.df.withColumns({f"{c}_mask": F.col(c).isNull().cast("byte") for c in p.cols}), masked=True)


def _outside(v: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    out = F.lit(False)
    if lo is not None:
        out = out | F.coalesce(v < lo, F.lit(False))
    if hi is not None:
        out = out | F.coalesce(v > hi, F.lit(False))
    return out


def _with_missing(c: str, flagged: Column, numeric: bool, missing_as: str) -> Column:
    null = F.col(c).isNull()
    if not numeric:
        return (F.when(~null, 0) if missing_as == "null" else null.cast("int")).cast("byte")
    at_null = {"ignore": F.lit(0), "flag": F.lit(1), "null": F.lit(None).cast("int")}[missing_as]
    return F.when(null, at_null).otherwise(flagged.cast("int")).cast("byte")


def _numeric(p: Panel, c: str) -> bool:
    return isinstance(p.df.schema[c].dataType, T.NumericType)


def reference_range(p: Panel, ranges: dict[str, tuple[float | None, float | None]], missing_as: str = "ignore") -> Panel:
    """1 where a value is below or above its range (bounds belong to it); variables without a range get 0."""
    _check(None, "global", missing_as, ranges)
    out = {}
    for c in p.cols:
        if c not in ranges:
            warnings.warn(f"{c} has no reference range")
        lo, hi = ranges.get(c, (None, None))
        out[f"{c}_mask"] = _with_missing(c, _outside(F.col(c), lo, hi), _numeric(p, c), missing_as)
    return replace(p, df=p.df.withColumns(out), masked=True)


def _check(method, scope, missing_as, ranges) -> None:
    if method not in ("iqr", "mad", None):
        raise ValueError(f"unknown method {method!r}")
    if scope not in ("global", "per_id"):
        raise ValueError(f"unknown scope {scope!r}")
    if missing_as not in ("ignore", "flag", "null"):
        raise ValueError(f"unknown missing_as {missing_as!r}")
    if method is None and not ranges:
        raise ValueError("neither a method nor reference ranges")


def _clean(p: Panel, c: str, ranges) -> Column:
    """The value if it is within its reference range."""
    lo, hi = (ranges or {}).get(c, (None, None))
    return F.when(~_outside(F.col(c), lo, hi), F.col(c).cast("double"))


def bounds(p: Panel, method: str, threshold: float, scope: str, ranges=None, by: list[str] = ()) -> DataFrame:
    """Columns {c}_lo and {c}_hi, one row for all, or one per id (or per value of `by`)."""
    keys = list(by) + ([p.id] if scope == "per_id" else [])
    cols = [c for c in p.cols if _numeric(p, c)]
    long = p.df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("v"), _clean(p, c, ranges).alias("x")) for c in cols))).alias("s")).select(*keys, "s.v", "s.x").where("x is not null and not isnan(x)")

    def middle(df: DataFrame, probs: dict[str, float], x: str) -> DataFrame:
        if scope == "per_id":
            return df.groupBy(*keys, "v").agg(*(F.percentile(x, q).alias(n) for n, q in probs.items()))
        return quantiles(df, [*keys, "v"], x, probs)

    if method == "iqr":
        b = middle(long, {"q1": 0.25, "q3": 0.75}, "x")
        reach = threshold * (F.col("q3") - F.col("q1"))
        b = b.select(*keys, "v", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    else:
        centre = middle(long, {"med": 0.5}, "x")
        spread = middle(long.join(centre, [*keys, "v"]).withColumn("d", F.abs(F.col("x") - F.col("med"))), {"mad": 0.5}, "d")
        reach = F.when(F.col("mad") > 0, threshold * F.col("mad") / MAD_SCALE)
        b = centre.join(spread, [*keys, "v"]).select(*keys, "v", (F.col("med") - reach).alias("lo"), (F.col("med") + reach).alias("hi"))
    return (b.groupBy(*keys) if keys else b.groupBy()).agg(*(F.max(F.when(F.col("v") == c, F.col(s))).alias(f"{c}_{s}") for c in cols for s in ("lo", "hi")))


def plausibility(p: Panel, method: str | None = "iqr", threshold: float = 1.5, scope: str = "global", missing_as: str = "ignore", ranges=None, by: list[str] = ()) -> Panel:
    """Reference ranges first, then bounds from the values within them; flagged by either. by: columns within which global bounds are taken."""
    _check(method, scope, missing_as, ranges)
    df, own, names = p.df, [], p.df.columns
    cols = [c for c in p.cols if _numeric(p, c)]
    if method and cols:
        b = bounds(p, method, threshold, scope, ranges, by)
        own = [c for c in b.columns if c not in by and c != p.id]
        keys = list(by) + ([p.id] if scope == "per_id" else [])
        df = df.join(b, keys, "left") if keys else df.crossJoin(F.broadcast(b))  # one row
    out = {}
    for c in p.cols:
        lo, hi = (ranges or {}).get(c, (None, None))
        flagged = F.lit(False)
        if c in cols:
            flagged = _outside(F.col(c), lo, hi)
            if method:
                flagged = flagged | _outside(F.col(c).cast("double"), F.col(f"{c}_lo"), F.col(f"{c}_hi"))
        out[f"{c}_mask"] = _with_missing(c, flagged, c in cols, missing_as)
    return replace(p, df=df.withColumns(out).select(*names, *out), masked=True)


def custom(p: Panel, mask: DataFrame) -> Panel:
    """Masks that the caller gives, by (id, clock_no), in columns named as the variables."""
    own = mask.select(p.id, p.clock_no, *(F.col(c).cast("byte").alias(f"{c}_mask") for c in p.cols))
    return replace(p, df=p.df.join(own, [p.id, p.clock_no]), masked=True)


def mask_frame(p: Panel) -> DataFrame:
    return p.df.select(*p.keys, *(p.mask(c).alias(c) for c in p.cols))


def mask_matrix(p: Panel, steps: int | None = None, variable: str | None = None) -> DataFrame:
    """One row per id (and variable), columns 1 … steps by clock_no; as many as the longest id has, unless a width for display is stated."""
    long = p.long([variable] if variable else None)
    if steps is None:
        steps = p.df.agg(F.max(p.clock_no)).collect()[0][0] or 0
    else:
        long = long.where(F.col(p.clock_no) <= steps)
    keys = [p.id] if variable else [p.id, "variable"]
    return long.groupBy(*keys).pivot(p.clock_no, list(range(1, steps + 1))).agg(F.first("mask"))
