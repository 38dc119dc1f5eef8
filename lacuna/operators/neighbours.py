"""What lies around imperfect rows and around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.operators.panel import Panel

BEFORE, AFTER, BOTH = "before", "after", "both"


def _frame(where: str, micros: int) -> list[tuple[int, int]]:
    """Ranges, in microseconds from a row, that hold an anchor such that the row lies `where` of it. The row's own time is left out."""
    out = []
    if where in (BEFORE, BOTH):
        out.append((1, micros))
    if where in (AFTER, BOTH):
        out.append((-micros, -1))
    if not out:
        raise ValueError(f"unknown window location {where!r}")
    return out


def _any(flag: Column, base, where: str, micros: int) -> Column:
    out = F.lit(0)
    for lo, hi in _frame(where, micros):
        out = F.greatest(out, F.coalesce(F.max(flag).over(base.rangeBetween(lo, hi)), F.lit(0)))
    return out


def near_flags(p: Panel, window_seconds: float = 300, where: str = BOTH) -> DataFrame:
    """The panel's rows with {c}_near: 1 if an imperfect row of c lies within the window (inclusive), other than at the same time. One sort, no join."""
    micros = int(window_seconds * 1_000_000)
    df = p.df.withColumn("_t", p.micros(F.col(p.clock)))
    base = W.partitionBy(p.id).orderBy("_t")
    return df.withColumns({f"{c}_near": _any(p.mask(c).cast("int"), base, where, micros) for c in p.cols}).drop("_t")


def values_near(p: Panel, c: str, window_seconds: float = 300, where: str = BOTH) -> DataFrame:
    """id, clock, value (the largest at that time), imperfect_times (sorted): observations of c near its imperfect rows.

    A range join on id and a bucket of one window's length; each imperfect row goes to the buckets that its window reaches.
    """
    micros = max(int(window_seconds * 1_000_000), 1)
    t = p.micros(F.col(p.clock))
    rows = p.df.select(p.id, p.clock, F.col(c).alias("value"), t.alias("_t"), F.floor(t / micros).alias("_b"))
    at = p.df.where(p.mask(c) == 1).select(p.id, F.col(p.clock).alias("_clock"), t.alias("_s"), F.explode(F.sequence(F.floor((t - micros) / micros), F.floor((t + micros) / micros))).alias("_b"))
    d = F.col("_t") - F.col("_s")
    cond = {BEFORE: d.between(-micros, -1), AFTER: d.between(1, micros), BOTH: d.between(-micros, micros) & (d != 0)}[where]
    joined = rows.join(at, [p.id, "_b"]).where(cond)
    return joined.groupBy(p.id, p.clock).agg(F.max("value").alias("value"), F.array_sort(F.collect_set("_clock")).alias("imperfect_times"))


def conditional_observations(p: Panel, c: str) -> DataFrame:
    """Rows where c is imperfect, with the other variables' values."""
    return p.df.where(p.mask(c) == 1).select(*p.keys, *[v for v in p.cols if v != c])


def conditional_window_observations(p: Panel, c: str, window_seconds: float = 300, where: str = BOTH) -> DataFrame:
    """id, clock, the largest value of every other variable, imperfect_times."""
    others = [v for v in p.cols if v != c]
    near = values_near(p, c, window_seconds, where).select(p.id, p.clock, "imperfect_times")
    return p.df.groupBy(p.id, p.clock).agg(*(F.max(v).alias(v) for v in others)).join(near, [p.id, p.clock])


def filter_events(events: DataFrame, name_col: str | None = None, names: list[str] | None = None) -> DataFrame:
    return events.where(F.col(name_col).isin(list(names))) if name_col and names else events


def event_mask(p: Panel, events: DataFrame, window_seconds: float = 0, where: str = BOTH, remove_ids_without_events: bool = True) -> DataFrame:
    """The panel's rows with event (boolean). Window 0: the rows nearest to each event, all ties; else rows within the window, before
    (clock < event), after (clock > event) or both. Ids must have rows of both kinds unless told otherwise."""
    own = events.select(p.id, F.col(p.clock).alias("_event")).where("_event is not null").distinct()
    if window_seconds == 0:
        df = _nearest(p, own)
    else:
        df = _windowed(p, own, window_seconds, where)
    if remove_ids_without_events:
        w = W.partitionBy(p.id)
        df = df.withColumns({"_some": F.max("event").over(w), "_all": F.min("event").over(w)}).where("_some and not _all").drop("_some", "_all")
    return df


def _nearest(p: Panel, events: DataFrame) -> DataFrame:
    """Per event the closest rows, found by one sort of rows and events: the last row before it and the first after it."""
    rows = p.df.select(p.id, p.micros(F.col(p.clock)).alias("_t"), F.lit(None).cast("bigint").alias("_e")).distinct()
    marks = events.select(p.id, p.micros(F.col("_event")).alias("_t"), p.micros(F.col("_event")).alias("_e"))
    w = W.partitionBy(p.id).orderBy("_t", F.col("_e").isNotNull())
    row_t = F.when(F.col("_e").isNull(), F.col("_t"))
    both = rows.unionByName(marks).withColumns({"_lo": F.last(row_t, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_hi": F.first(row_t, True).over(w.rowsBetween(0, W.unboundedFollowing))})
    best = both.where("_e is not null").select(p.id, "_lo", "_hi", (F.col("_e") - F.col("_lo")).alias("_a"), (F.col("_hi") - F.col("_e")).alias("_z"))
    lo = best.where("_lo is not null and (_hi is null or _a <= _z)").select(p.id, F.col("_lo").alias("_t"))
    hi = best.where("_hi is not null and (_lo is null or _z <= _a)").select(p.id, F.col("_hi").alias("_t"))
    hit = lo.unionByName(hi).distinct().withColumn("event", F.lit(True))
    return p.df.withColumn("_t", p.micros(F.col(p.clock))).join(hit, [p.id, "_t"], "left").withColumn("event", F.coalesce("event", F.lit(False))).drop("_t")


def _windowed(p: Panel, events: DataFrame, window_seconds: float, where: str) -> DataFrame:
    """Rows and events in one sequence per id; a row's flag is the maximum over a range of times."""
    micros = int(window_seconds * 1_000_000)
    rows = p.df.withColumns({"_t": p.micros(F.col(p.clock)), "_e": F.lit(0)})
    marks = events.select(p.id, p.micros(F.col("_event")).alias("_t"), F.lit(1).alias("_e"))
    base = W.partitionBy(p.id).orderBy("_t")
    frames = _frame(where, micros) if where != BOTH else [(-micros, micros)]
    flag = F.lit(0)
    for lo, hi in frames:
        flag = F.greatest(flag, F.coalesce(F.max("_e").over(base.rangeBetween(lo, hi)), F.lit(0)))
    return rows.unionByName(marks, allowMissingColumns=True).withColumn("event", flag == 1).where("_e = 0").drop("_t", "_e")


def event_share(masked: DataFrame) -> DataFrame:
    return masked.agg((F.avg(F.col("event").cast("double")) * 100).alias("event_pct"), F.count_if("event").alias("n_event"), F.count(F.lit(1)).alias("n"))
