"""Ranks, cumulative counts and exact quantiles over whole tables, without sorting a key's rows in one task.

Values are counted first (map-side), then cut into buckets at approximate quantiles; windows run within a
bucket and bucket totals are added up over at most BUCKETS rows a key. Results are exact whatever the cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.expr import fused

BUCKETS = 256


def ordered_counts(df: DataFrame, keys: list[str], value: str, sums: list[str] = ()) -> DataFrame:
    """keys, value, n, below (rows with smaller values), of (rows of the key); for each name in sums also the sum over equal values and {name}_below."""
    ks = keys or ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(0))
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*ks, value).agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(s) for s in sums))
    cuts = counts.groupBy(*ks).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 2000).alias("_cuts"))
    dealt = counts.join(cuts, ks).withColumn("_b", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value)))).drop("_cuts")
    tot = dealt.groupBy(*ks, "_b").agg(F.sum("n").alias("_n"), *(F.sum(s).alias(f"_s_{s}") for s in sums))
    up_to, whole = W.partitionBy(*ks).orderBy("_b"), W.partitionBy(*ks)
    tot = tot.select(*ks, "_b", (F.sum("_n").over(up_to) - F.col("_n")).alias("_n0"), F.sum("_n").over(whole).alias("of"), *((F.sum(f"_s_{s}").over(up_to) - F.col(f"_s_{s}")).alias(f"_s0_{s}") for s in sums))
    own = W.partitionBy(*ks, "_b").orderBy(value)
    out = dealt.join(tot, [*ks, "_b"])
    return out.select(
        *keys, value, "n", (F.col("_n0") + F.sum("n").over(own) - F.col("n")).alias("below"), "of",
        *[c for s in sums for c in (F.col(s), (F.col(f"_s0_{s}") + F.sum(s).over(own) - F.col(s)).alias(f"{s}_below"))],
    )


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, rank (average over ties, from 1), n (ties)."""
    return ordered_counts(df, keys, value).select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias("rank"), "n", "of")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], nearest: bool = False) -> DataFrame:
    """keys and one column per name: exact quantiles with linear interpolation, or the element at round-half-up((n - 1) q)."""
    o = ordered_counts(df, keys, value)
    aggs = []
    for name, p in probs.items():
        at = (F.col("of") - 1) * F.lit(float(p))
        at = F.floor(at + 0.5) if nearest else at
        lo, hi = F.floor(at), F.ceil(at)
        end = F.col("below") + F.col("n")
        a = F.max(F.when((F.col("below") <= lo) & (lo < end), F.col(value).cast("double")))
        b = F.max(F.when((F.col("below") <= hi) & (hi < end), F.col(value).cast("double")))
        d = F.max(at - lo)
        aggs.append(F.when(d == 0, a).otherwise(fused(a, 1 - d, b * d)).alias(name))  # to the last bit as the SQL has it, for limits that are made of quantiles
    return (o.groupBy(*keys) if keys else o.groupBy()).agg(*aggs)
