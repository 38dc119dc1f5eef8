"""The observation panel: one row per (id, clock), values in wide columns, masks on the same rows."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.expr import epoch_micros, seconds_between

#: Types that numeric analyses accept.
NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    cols: list[str]
    id: str = "id"
    clock: str = "clock"
    clock_no: str = "clock_no"
    masked: bool = False

    @staticmethod
    def of(df: DataFrame, id: str = "id", clock: str = "clock", clock_no: str = "clock_no", cols: list[str] | None = None) -> "Panel":
        """Adds clock_no (1, 2, … within an id by clock) if it is not there."""
        if clock_no not in df.columns:
            df = df.withColumn(clock_no, F.row_number().over(W.partitionBy(id).orderBy(clock)))
        own = [c for c in df.columns if c not in (id, clock, clock_no)]
        return Panel(df, list(cols) if cols is not None else own, id, clock, clock_no)

    def validated(self) -> "Panel":
        """Drops rows without a clock and unknown variables; warns about small or empty input."""
        missing = [c for c in (self.id, self.clock) if c not in self.df.columns]
        if missing:
            raise ValueError(f"no column {missing}")
        known = [c for c in self.cols if c in self.df.columns]
        if known != self.cols:
            warnings.warn(f"unknown variables are left out: {sorted(set(self.cols) - set(known))}")
        df = self.df.where(F.col(self.clock).isNotNull())
        n = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(known))).collect()[0]
        if n["n"] < 50:
            warnings.warn("fewer than 50 rows")
        for i, c in enumerate(known):
            if n[f"c{i}"] == 0:
                warnings.warn(f"{c} holds nulls only")
            elif n[f"c{i}"] == n["n"]:
                warnings.warn(f"{c} holds no nulls")
        return replace(self, df=df, cols=known)

    @property
    def clock_type(self) -> T.DataType:
        return self.df.schema[self.clock].dataType

    @property
    def keys(self) -> list[str]:
        return [self.id, self.clock, self.clock_no]

    @property
    def w(self):
        return W.partitionBy(self.id).orderBy(self.clock, self.clock_no)

    def mask(self, c: str) -> Column:
        return F.col(f"{c}_mask")

    def masks(self) -> list[Column]:
        return [self.mask(c).cast("int") for c in self.cols]

    def seconds(self, before: Column, after: Column) -> Column:
        return seconds_between(self.clock_type, before, after)

    def micros(self, clock: Column) -> Column:
        return epoch_micros(self.clock_type, clock)

    def is_numeric(self, c: str) -> bool:
        return isinstance(self.df.schema[c].dataType, NUMERIC)

    def numeric(self) -> list[str]:
        return [c for c in self.cols if self.is_numeric(c)]

    def long(self, cols: list[str] | None = None, extra: list[str] = ()) -> DataFrame:
        """id, clock, clock_no, variable, mask, value (double, null for other types)."""
        parts = [F.struct(F.lit(c).alias("variable"), (self.mask(c).cast("int") if self.masked else F.lit(None).cast("int")).alias("mask"), (F.col(c).cast("double") if self.is_numeric(c) else F.lit(None).cast("double")).alias("value")) for c in (cols or self.cols)]
        return self.df.select(*self.keys, *extra, F.explode(F.array(*parts)).alias("_v")).select(*self.keys, *extra, "_v.variable", "_v.mask", "_v.value")
