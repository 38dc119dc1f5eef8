"""Building cohorts from stays and events: ids that several tables share, returns within a time, regular grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.expr import epoch_micros


def common_ids(frames: list[DataFrame], id_col: str) -> DataFrame:
    """Ids that all frames hold."""
    return reduce(lambda a, b: a.join(b, id_col, "left_semi"), [f.select(id_col).where(F.col(id_col).isNotNull()) for f in frames]).distinct()


def returns_within(stays: DataFrame, id_col: str, start: str, end: str, seconds: int, name: str = "returned") -> DataFrame:
    """Stays with `name`: whether a later stay of the id starts at or after this one's end and within so many seconds of it.

    The next start after an end is the only one that matters, so that a sort by id takes the place of a join of stays with stays:
    starts and ends are put on one line, and each end looks at the first start behind it.
    """
    w = W.partitionBy("_id").orderBy("_t", F.desc("_kind")).rowsBetween(1, W.unboundedFollowing)  # an end before starts at the same time
    line = stays.select(F.col(id_col).alias("_id"), F.explode(F.array(F.struct(F.col(start).alias("_t"), F.lit(1).alias("_kind")), F.struct(F.col(end).alias("_t"), F.lit(2).alias("_kind")))).alias("s")).select("_id", "s.*")
    ahead = F.first(F.when(F.col("_kind") == 1, F.col("_t")), True).over(w)
    nxt = line.withColumn("_next", ahead).where("_kind = 2").groupBy("_id", "_t").agg(F.min("_next").alias("_next"))
    out = stays.join(nxt, (F.col(id_col) == F.col("_id")) & (F.col(end) == F.col("_t")), "left")
    return out.withColumn(name, F.coalesce(F.col("_next") <= F.col(end) + F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))).drop("_id", "_t", "_next")


def upsample(df: DataFrame, id_col: str, clock: str, cols: list[str], seconds: int = 1800, backward: bool = True) -> DataFrame:
    """One row per id and step of `seconds` from the id's first to its last: each variable's last value of the step, then the last one before, then (backward) the first one after."""
    step = F.floor(epoch_micros(df.schema[clock].dataType, F.col(clock)) / (seconds * 1_000_000)).cast("bigint")
    binned = df.withColumn("step", step).groupBy(id_col, "step").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(clock))).alias(c) for c in cols))
    grid = binned.groupBy(id_col).agg(F.min("step").alias("_a"), F.max("step").alias("_b")).select(id_col, F.explode(F.sequence("_a", "_b")).alias("step"))
    w = W.partitionBy(id_col).orderBy("step")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) if backward else F.last(c, True).over(before) for c in cols}
    return grid.join(binned, [id_col, "step"], "left").select(id_col, "step", *(v.alias(c) for c, v in filled.items()))
