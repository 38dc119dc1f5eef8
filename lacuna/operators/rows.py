"""Imperfection by column, by row and by case, and its patterns over variables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.expr import ratio, sorted_sum, total
from lacuna.operators.panel import Panel


def column_statistics(p: Panel) -> DataFrame:
    """Per variable: indicated_count, indicated_pct of all rows, non_indicated_count; by pct, descending."""
    n = F.count(F.lit(1))
    aggs = [F.struct(F.lit(c).alias("variable"), F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias("indicated_count"), (F.coalesce(F.sum(m), F.lit(0)) * 100 / F.nullif(n, F.lit(0))).alias("indicated_pct"), (n - F.coalesce(F.sum(m), F.lit(0))).cast("bigint").alias("non_indicated_count")) for c, m in zip(p.cols, p.masks())]
    return p.df.agg(F.explode(F.array(*aggs)).alias("s")).select("s.*").orderBy(F.desc("indicated_pct"), "variable")


def column_statistics_per_id(p: Panel, threshold: float = 5.0) -> DataFrame:
    n = F.count(F.lit(1))
    aggs = [n.alias("total_count")]
    for c, m in zip(p.cols, p.masks()):
        count = F.coalesce(F.sum(m), F.lit(0))
        aggs += [count.cast("bigint").alias(f"{c}_indicated_count"), (count * 100 / n).alias(f"{c}_indicated_pct"), (count * 100 / n > threshold).alias(f"{c}_above_{threshold:g}pct_threshold")]
    return p.df.groupBy(p.id).agg(*aggs)


def _all(p: Panel):
    cond = F.lit(True)
    for m in p.masks():
        cond = cond & F.coalesce(m == 1, F.lit(False))
    return cond


def all_imperfect_rows(p: Panel) -> DataFrame:
    return p.df.agg(F.count_if(_all(p)).alias("null_rows_count"), (F.count_if(_all(p)) * 100 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("null_rows_pct"))


def all_imperfect_rows_per_id(p: Panel) -> DataFrame:
    n = F.count(F.lit(1))
    return p.df.groupBy(p.id).agg(F.count_if(_all(p)).alias("null_vitals_count"), n.alias("total_rows_per_id"), (F.count_if(_all(p)) * 100 / n).alias("null_vitals_pct")).orderBy(F.desc("null_vitals_pct"), p.id)


def row_statistics(p: Panel) -> DataFrame:
    """indicated_vars (null if any mask is null) and its percentage, per row."""
    s = total(p.masks())
    return p.df.select(*p.keys, s.cast("bigint").alias("indicated_vars"), (s * 100 / len(p.cols)).alias("indicated_vars_pct"))


def row_statistics_per_id(p: Panel) -> DataFrame:
    return row_statistics(p).groupBy(p.id).agg(F.avg("indicated_vars_pct").alias("avg_indicated_vars_pct")).orderBy(F.desc("avg_indicated_vars_pct"), p.id)


def patterns(p: Panel) -> DataFrame:
    """Combinations of masks and how often they occur, most frequent first."""
    return p.df.groupBy(*(p.mask(c).alias(c) for c in p.cols)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *p.cols)


def case_metrics(p: Panel) -> DataFrame:
    """Per id: avg_indicated_pct, co_concentration, breadth, pattern_entropy, max_pair_overlap."""
    d, masks = len(p.cols), {c: F.coalesce(p.mask(c).cast("int"), F.lit(0)) for c in p.cols}
    s = total(list(masks.values()))
    aggs = [
        # from whole sums: an average of quotients would depend on the order of the rows
        (F.sum(s) * 100 / (F.count(F.lit(1)) * d)).alias("avg_indicated_pct"), ratio(F.sum(s) * 100, F.count_if(s > 0) * d).alias("co_concentration"),
        (total([F.max(m) for m in masks.values()]) / d).alias("breadth"),
    ]
    overlap = F.lit(None).cast("double")
    if d >= 2:
        each = []
        for a, b in combinations(p.cols, 2):
            least = F.least(F.sum(masks[a]), F.sum(masks[b]))
            each.append(F.when(least == 0, 0.0).otherwise(ratio(F.sum(masks[a] * masks[b]), least)))
        overlap = F.greatest(*each) if len(each) > 1 else each[0]
    base = p.df.groupBy(p.id).agg(*aggs, overlap.alias("max_pair_overlap"))
    bits = F.concat(*(m.cast("string") for m in masks.values())) if d > 1 else next(iter(masks.values())).cast("string")
    per = p.df.where(s > 0).groupBy(p.id, bits.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(W.partitionBy(p.id))
    shape = per.withColumn("_q", share).groupBy(p.id).agg(F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(sorted_sum(-F.col("_q") * F.log2("_q")) / F.nullif(F.log2(F.count(F.lit(1)).cast("double")), F.lit(0.0))).alias("pattern_entropy"))
    return base.join(shape, p.id, "left").select(p.id, "avg_indicated_pct", "co_concentration", "breadth", "pattern_entropy", "max_pair_overlap")
