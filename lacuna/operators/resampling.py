"""Bootstrap intervals of rank statistics at any size: values are counted, cut into buckets, and resampled bucket by bucket.

A draw of n of a group's n values is a multinomial over its distinct values. It is taken in two steps that give the same
distribution: how many fall into each bucket (a few numbers a key), then which values within the bucket (one task a bucket).
Rank sums and ties add up over buckets, so that no task sees more of a key than one bucket or the totals of all buckets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.kernels import SEED
from lacuna.functions.order import BUCKETS
from lacuna.sources.store import stored

#: Cells (draws times distinct values of a bucket) that are drawn at once.
CELLS = 2_000_000


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr([str(p) for p in parts]).encode()))


def _draw(rng: np.random.Generator, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each size, how often every value comes in so many draws from values that occur n times: row by row where most values are different, else a multinomial at once."""
    if len(n) * 8 < n.sum():
        return rng.multinomial(sizes, n / n.sum())
    value = np.repeat(np.arange(len(n)), n)
    row = np.repeat(np.arange(len(sizes)) * len(n), sizes)
    return np.bincount(row + value[rng.integers(0, len(value), len(row))], minlength=len(sizes) * len(n)).reshape(len(sizes), len(n))


def _rank_sums(left: pd.DataFrame, right: pd.DataFrame, ks: list[str], draws: int, seed: int) -> pd.DataFrame:
    """For one bucket: of each draw the rank sum of every group, counted from the bucket's start, and the tie term of all groups."""
    if left.empty:
        return pd.DataFrame(columns=[*ks, "_b", "_g", "_c", "_r", "_t"])
    key = left[[*ks, "_b"]].iloc[0]
    values, at = np.unique(left["_v"].to_numpy(), return_inverse=True)
    drawn = {g: np.asarray(c) for g, c in zip(right["_g"], right["_c"])}
    names = sorted(drawn)
    own = {g: (at[(left["_g"] == g).to_numpy()], left.loc[left["_g"] == g, "n"].to_numpy()) for g in names}
    rngs = {g: _rng(seed, *key, g) for g in names}
    sums, ties, step = {g: [] for g in names}, [], max(1, CELLS // len(values))
    for start in range(0, draws, step):
        size = min(step, draws - start)
        counts, whole = {}, np.zeros((size, len(values)), dtype=np.int64)
        for g in names:
            where, n = own[g]
            c = np.zeros_like(whole)
            c[:, where] = _draw(rngs[g], drawn[g][start : start + size], n)
            counts[g] = c
            whole += c
        middle = np.cumsum(whole, axis=1) - whole + (whole + 1) / 2
        for g in names:
            sums[g].append((counts[g] * middle).sum(axis=1))
        t = whole.astype(float)
        ties.append((t**3 - t).sum(axis=1))
    tie = np.concatenate(ties)
    return pd.DataFrame([[*key, g, drawn[g], np.concatenate(sums[g]), tie] for g in names], columns=[*ks, "_b", "_g", "_c", "_r", "_t"])


def _interval(pdf: pd.DataFrame, statistic, confidence: float) -> tuple[float | None, float | None]:
    """Percentile interval over the draws of statistic(rank sums by group, sizes by group, tie term)."""
    names = sorted(pdf["_g"].unique())
    below, ties = 0.0, 0.0
    sums, sizes = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for _, bucket in pdf.sort_values("_b").groupby("_b"):
        here = 0.0
        for g, c, r in zip(bucket["_g"], bucket["_c"], bucket["_r"]):
            c = np.asarray(c, dtype=float)
            sums[g] = sums[g] + np.asarray(r) + c * below
            sizes[g] = sizes[g] + c
            here = here + c
        below, ties = below + here, ties + np.asarray(bucket["_t"].iloc[0])
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.asarray(statistic([sums[g] for g in names], [sizes[g] for g in names], ties), dtype=float)
    found = found[np.isfinite(found)]
    if not found.size:
        return None, None
    return tuple(float(q) for q in np.quantile(found, [0.5 - confidence / 2, 0.5 + confidence / 2]))


def _rank_biserial(sums: list, sizes: list, ties) -> np.ndarray:
    """Of the second of two groups against the first."""
    if len(sums) != 2:
        return np.array([])
    return 2 * (sums[1] - sizes[1] * (sizes[1] + 1) / 2) / (sizes[0] * sizes[1]) - 1


def _eta_squared(sums: list, sizes: list, ties) -> np.ndarray:
    n, k = sum(sizes), len(sums)
    if k < 2:
        return np.array([])
    h = 12 / (n * (n + 1)) * sum(r * r / m for r, m in zip(sums, sizes)) - 3 * (n + 1)
    return (h / (1 - ties / (n**3 - n)) - k + 1) / (n - k)


def _bootstrap(df: DataFrame, keys: list[str], value: str, group: str, statistic, draws: int, confidence: float, seed: int) -> DataFrame:
    ks = keys or ["_all"]
    df = df if keys else df.withColumn("_all", F.lit(0))
    rows = df.select(*ks, F.col(group).cast("string").alias("_g"), F.col(value).cast("double").alias("_v")).where("_g is not null and _v is not null and not isnan(_v)")
    counts = stored(rows.groupBy(*ks, "_g", "_v").agg(F.count(F.lit(1)).alias("n")), "counts")  # read for cuts, totals and draws
    cuts = counts.groupBy(*ks).agg(F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 2000).alias("_cuts"))
    dealt = counts.join(cuts, ks).select(*ks, "_g", "_v", "n", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_v"))).alias("_b"))
    totals = dealt.groupBy(*ks, "_g", "_b").agg(F.sum("n").alias("n"))
    key_fields = [rows.schema[k] for k in ks]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """How many of each draw's values fall into each bucket, for one group of one key: at most BUCKETS rows."""
        pdf = pdf.sort_values("_b")
        n = pdf["n"].to_numpy()
        c = _rng(seed, *pdf[[*ks, "_g"]].iloc[0]).multinomial(int(n.sum()), n / n.sum(), size=draws)
        return pdf[[*ks, "_g", "_b"]].assign(_c=list(c.T))

    drawn = T.StructType([*key_fields, T.StructField("_g", T.StringType()), T.StructField("_b", T.IntegerType()), T.StructField("_c", T.ArrayType(T.LongType()))])
    per = T.StructType([*key_fields, T.StructField("_b", T.IntegerType()), T.StructField("_g", T.StringType()), T.StructField("_c", T.ArrayType(T.LongType())), T.StructField("_r", T.ArrayType(T.DoubleType())), T.StructField("_t", T.ArrayType(T.DoubleType()))])
    out = T.StructType([*key_fields, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    shares = totals.groupBy(*ks, "_g").applyInPandas(deal, drawn)
    ranked = dealt.groupBy(*ks, "_b").cogroup(shares.groupBy(*ks, "_b")).applyInPandas(lambda left, right: _rank_sums(left, right, ks, draws, seed), per)
    found = ranked.groupBy(*ks).applyInPandas(lambda pdf: pd.DataFrame([[*pdf[ks].iloc[0], *_interval(pdf, statistic, confidence)]], columns=[*ks, "low", "high"]), out)
    return found if keys else found.drop("_all")


def rank_biserial_interval(df: DataFrame, keys: list[str], value: str, first: str, draws: int = 1000, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """keys, low, high: percentile interval of the rank-biserial correlation of rows where `first` is true against the others. Null where one side has no value; rows without value or side take no part."""
    return _bootstrap(df, keys, value, first, _rank_biserial, draws, confidence, seed)


def eta_squared_interval(df: DataFrame, keys: list[str], value: str, group: str, draws: int = 1000, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """keys, low, high: percentile interval of Kruskal-Wallis' eta squared over groups resampled each at its own size. Null below two groups; draws without variation take no part."""
    return _bootstrap(df, keys, value, group, _eta_squared, draws, confidence, seed)
