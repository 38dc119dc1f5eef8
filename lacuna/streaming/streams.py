"""The panel's stateless steps on streams, and intervals and gaps with state per id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import masks
from lacuna.operators.panel import Panel


def stream_masks(df: DataFrame, cols: list[str], id: str = "id", clock: str = "clock", ranges=None, missing_as: str = "ignore") -> DataFrame:
    """Missingness or range masks: expressions on a row, so they hold on a stream as they are."""
    p = Panel(df.withColumn("clock_no", F.lit(None).cast("long")), cols, id, clock)
    return (masks.reference_range(p, ranges, missing_as) if ranges else masks.missingness(p)).df.drop("clock_no")


def imperfection_rates(masked: DataFrame, cols: list[str], clock: str = "clock", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per event-time window: rows and imperfect rows of each variable; rows later than the watermark are dropped."""
    rows = masked.withWatermark(clock, late).groupBy(F.window(clock, window))
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"{c}_mask").cast("int")).alias(f"{c}_indicated_count") for c in cols)).select(F.col("window.start").alias("start"), "*").drop("window")


def stream_intervals(df: DataFrame, id: str = "id", clock: str = "clock", timeout: str | None = "1 day") -> DataFrame:
    """id, clock, interval_seconds between an id's rows in order of arrival batches, sorted within each; state is the last clock (microseconds), kept `timeout` long after the id's last row (None: for good; with a timeout a query runs on without new rows)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    ms = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else 0

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("clock")
        t = rows["clock"].astype("int64") // (1000 if rows["clock"].dtype == "datetime64[ns]" else 1)
        before = t.shift(1)
        if last is not None:
            before.iloc[0] = last
        out = pd.DataFrame({"id": key[0], "clock": rows["clock"], "interval_seconds": ((t - before) // 1_000_000)})
        state.update((int(max(t.iloc[-1], last if last is not None else t.iloc[-1])),))
        if ms:
            state.setTimeoutDuration(ms)
        yield out[out["interval_seconds"] > 0].astype({"interval_seconds": "int64"})

    own = df.select(F.col(id).alias("id"), F.col(clock).alias("clock"))
    kind = own.schema["id"].dataType.simpleString()
    clock_kind = own.schema["clock"].dataType.simpleString()
    return own.groupBy("id").applyInPandasWithState(run, f"id {kind}, clock {clock_kind}, interval_seconds long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout)
