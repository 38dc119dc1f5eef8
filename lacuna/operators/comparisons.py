"""Comparisons: rank statistics at any size in SQL, full tests per facet in Arrow batches, tests of co-imperfection."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import kernels as K
from lacuna.functions import ranksums as R
from lacuna.functions.expr import each_row, ratio
from lacuna.functions.order import average_ranks, ordered_counts, quantiles
from lacuna.operators.panel import Panel
from lacuna.sources.store import stored

#: Distinct rows of a block in the normality test.
BLOCK_ROWS = 8192


# --- two and more groups, distributed -----------------------------------------------------------


def mann_whitney(df: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """keys, n1, n2, u (of rows where `first` is true), rank_biserial, z and p_value (normal, tie and continuity corrected), means and sds."""
    rows = df.where(F.col(value).isNotNull()).withColumns({"_1": F.col(first).cast("int"), "_v": F.col(value).cast("double")})
    o = ordered_counts(rows, keys, "_v", ["_1"])
    n, n1 = F.max("of"), F.sum("_1")
    rank = F.col("below") + (F.col("n") + 1) / 2
    u = F.sum(F.col("_1") * rank) - n1 * (n1 + 1) / 2
    ties = F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"))
    v, m = F.col("_v"), F.col("_1")
    mean = lambda w: F.sum(w * v) / F.nullif(F.sum(w), F.lit(0))
    out = (o.groupBy(*keys) if keys else o.groupBy()).agg(n1.cast("bigint").alias("n1"), (n - n1).cast("bigint").alias("n2"), u.alias("u"), ties.alias("_ties"), mean(m).alias("mean1"), mean(F.col("n") - m).alias("mean2"))
    nn = F.col("n1") * F.col("n2")
    tot = (F.col("n1") + F.col("n2")).cast("double")
    var = nn / 12.0 * ((tot + 1) - F.col("_ties") / F.nullif(tot * (tot - 1), F.lit(0.0)))
    z = (F.greatest(F.col("u"), nn - F.col("u")) - nn / 2.0 - 0.5) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))
    out = out.withColumns({"rank_biserial": 2 * F.col("u") / F.nullif(nn.cast("double"), F.lit(0.0)) - 1, "z": z})
    tail = F.pandas_udf(lambda s: s.map(lambda x: None if pd.isna(x) else min(1.0, 2 * K.normal_sf(x))), "double")
    return out.withColumn("p_value", tail("z")).drop("_ties")


def cliffs_delta(df: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """keys, n1, n2, delta and Cliff's (1993) interval at 95 %, from cumulative counts."""
    rows = df.where(F.col(value).isNotNull()).withColumns({"_1": F.col(first).cast("bigint"), "_2": (~F.col(first)).cast("bigint"), "_v": F.col(value).cast("double")})
    o = ordered_counts(rows, keys, "_v", ["_1", "_2"])
    tot = (o.groupBy(*keys) if keys else o.groupBy()).agg(F.sum("_1").alias("n1"), F.sum("_2").alias("n2"))
    o = o.join(tot, keys) if keys else o.crossJoin(F.broadcast(tot))  # one row
    di = (2 * F.col("_2_below") + F.col("_2") - F.col("n2")) / F.nullif(F.col("n2"), F.lit(0))
    dj = -(2 * F.col("_1_below") + F.col("_1") - F.col("n1")) / F.nullif(F.col("n1"), F.lit(0))
    o = o.withColumns({"_di": di, "_dj": dj})
    agg = o.groupBy(*keys, "n1", "n2").agg((F.sum(F.col("_1") * F.col("_di")) / F.nullif(F.col("n1"), F.lit(0))).alias("delta"), F.sum(F.col("_1") * F.col("_di") * F.col("_di")).alias("_si"), F.sum(F.col("_2") * F.col("_dj") * F.col("_dj")).alias("_sj"), F.sum(F.col("_1") * F.col("_2")).alias("_ties"))
    n1, n2, d, z = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("delta"), K.normal_ppf(0.975)
    rows_ss, cols_ss = F.col("_si") - n1 * d * d, F.col("_sj") - n2 * d * d
    var = F.greatest((n2 * n2 * rows_ss + n1 * n1 * cols_ss - (n1 * n2 - F.col("_ties") - n1 * n2 * d * d)) / F.nullif(n1 * n2 * (n1 - 1) * (n2 - 1), F.lit(0.0)), F.lit(0.0))
    ok = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    agg = agg.withColumn("_var", F.when(ok, var))
    den = 1 - d * d + z * z * F.col("_var")
    reach = z * F.sqrt("_var") * F.sqrt((1 - d * d) * (1 - d * d) + z * z * F.col("_var"))
    bound = lambda s: F.when(den <= 0, d).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d - d * d * d + s * reach) / F.nullif(den, F.lit(0.0)))))
    return agg.select(*keys, "n1", "n2", "delta", F.when(ok, bound(-1)).alias("low"), F.when(ok, bound(1)).alias("high"))


def kruskal_wallis(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """keys, k, n, h (tie-corrected), eta_squared, p_value."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ranks = average_ranks(rows, keys, "_v")
    per = rows.groupBy(*keys, "_g", "_v").agg(F.count(F.lit(1)).alias("c")).join(ranks, [*keys, "_v"]).groupBy(*keys, "_g").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("m"))
    n = F.sum("m").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("m")) - 3 * (n + 1)
    agg = (per.groupBy(*keys) if keys else per.groupBy()).agg(F.count(F.lit(1)).alias("k"), F.sum("m").cast("bigint").alias("n"), h.alias("_h"))
    t = F.col("n").cast("double")
    tie = (ranks.groupBy(*keys) if keys else ranks.groupBy()).agg(F.sum(t * t * t - t).alias("_t"))
    out = agg.join(tie, keys) if keys else agg.crossJoin(F.broadcast(tie))  # one row
    fix = 1 - F.col("_t") / F.nullif(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n"), F.lit(0.0))
    out = out.withColumn("h", F.when((F.col("k") > 1) & (fix > 0), F.col("_h") / F.nullif(fix, F.lit(0.0))))
    tail = F.pandas_udf(lambda h, k: pd.Series([None if pd.isna(a) else K.chi2_sf(a, b - 1) for a, b in zip(h, k)], dtype="float64"), "double")
    return out.select(*keys, "k", "n", "h", ratio(F.col("h") - F.col("k") + 1, F.col("n") - F.col("k")).alias("eta_squared"), tail("h", "k").alias("p_value"))


def t_test(df: DataFrame, keys: list[str], value: str, first: str, confidence: float = 0.95) -> DataFrame:
    """keys, n1, n2, mean_difference, t, df, p_value, its interval, cohens_d, equal_var: pooled if the standard deviations agree within a relative 1e-5, else Welch's. Null below two values a side or without spread."""
    v, one = F.col(value).cast("double"), F.col(first)
    side = lambda agg, c: agg(F.when(c, v))
    rows = df.where(F.col(value).isNotNull() & one.isNotNull())
    aggs = [f(side(g, c)).alias(f"{name}{i}") for i, c in ((1, one), (2, ~one)) for name, g, f in (("n", F.count, lambda x: x), ("_m", F.avg, lambda x: x), ("_v", F.var_samp, lambda x: x))]
    out = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "_v1", "_v2"))
    ok = (n1 >= 2) & (n2 >= 2)
    equal = F.abs(F.sqrt(v1) - F.sqrt(v2)) <= 1e-8 + 1e-5 * F.sqrt(v2)
    pooled, a, b = ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2), v1 / n1, v2 / n2
    free = F.when(equal, n1 + n2 - 2).otherwise(ratio((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)))
    se = F.when(equal, F.sqrt(pooled * (1 / n1 + 1 / n2))).otherwise(F.sqrt(a + b))
    out = out.where(ok).withColumns({"mean_difference": F.col("_m1") - F.col("_m2"), "equal_var": equal, "df": free, "_se": F.nullif(se, F.lit(0.0)), "_sd": F.when(equal, F.sqrt(pooled)).otherwise(F.sqrt((v1 + v2) / 2))})
    out = out.withColumn("t", F.col("mean_difference") / F.col("_se"))
    each = lambda f: F.pandas_udf(lambda x, d: pd.Series([None if pd.isna(i) or pd.isna(j) else f(i, j) for i, j in zip(x, d)], dtype="float64"), "double")  # noqa: E731  one row a test
    reach = each(lambda _, d: K.t_ppf(0.5 + confidence / 2, d))("t", "df") * F.col("_se")
    told = out.select(*keys, "n1", "n2", "mean_difference", "t", "df", each(lambda t, d: 2 * K.t_sf(abs(t), d))("t", "df").alias("p_value"), (F.col("mean_difference") - reach).alias("low"), (F.col("mean_difference") + reach).alias("high"), ratio(F.col("mean_difference"), F.col("_sd")).alias("cohens_d"), "equal_var")
    return told


def brown_forsythe(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """keys, k, n, w, p_value: equality of spreads by an analysis of variance of the distances from each group's median."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    own = [*keys, "_g"]
    z = rows.join(quantiles(rows, own, "_v", {"_med": 0.5}), own).withColumn("_z", F.abs(F.col("_v") - F.col("_med")))
    per = z.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.avg("_z").alias("_m"), F.var_pop("_z").alias("_var"))
    n, k = F.sum("_n").cast("double"), F.count(F.lit(1))
    mean = F.sum(F.col("_n") * F.col("_m")) / n
    between = F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - n * mean * mean
    within = F.sum(F.col("_n") * F.col("_var"))
    aggs = [k.alias("k"), n.cast("bigint").alias("n"), F.when((k > 1) & (n > k) & (within > 0), (n - k) / F.nullif(k - 1, F.lit(0)) * between / F.nullif(within, F.lit(0.0))).alias("w")]
    out = per.groupBy(*keys).agg(*aggs) if keys else per.agg(*aggs)
    tail = F.pandas_udf(lambda w, k, n: pd.Series([None if pd.isna(a) else K.f_sf(a, b - 1, c - b) for a, b, c in zip(w, k, n)], dtype="float64"), "double")  # one row a test
    return out.withColumn("p_value", tail("w", "k", "n"))


def dunn(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """keys, group_a, group_b, z, p_value (Holm): Dunn's test of every pair of groups on the ranks of all; z is positive where group_a ranks higher."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ranks = average_ranks(rows, keys, "_v")
    per = rows.groupBy(*keys, "_g", "_v").agg(F.count(F.lit(1)).alias("_c")).join(ranks, [*keys, "_v"]).groupBy(*keys, "_g").agg((F.sum(F.col("_c") * F.col("rank")) / F.sum("_c")).alias("_r"), F.sum("_c").alias("_m"))
    t = F.col("n").cast("double")
    tie = ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("_t"), F.max("of").cast("double").alias("_n"))
    a, b = (per.select(*keys, F.col("_g").alias(f"group_{x}"), F.col("_r").alias(f"_r{x}"), F.col("_m").alias(f"_m{x}")) for x in "ab")
    pairs = (a.join(b, keys) if keys else a.crossJoin(b)).where("group_a < group_b")  # one row a group
    pairs = pairs.join(tie, keys) if keys else pairs.crossJoin(F.broadcast(tie))
    n = F.col("_n")
    var = n * (n + 1) / 12 - F.col("_t") / F.nullif(12 * (n - 1), F.lit(0.0))
    z = F.coalesce((F.col("_ra") - F.col("_rb")) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0)) * (1 / F.col("_ma") + 1 / F.col("_mb"))), F.lit(0.0)), F.lit(0.0))
    tail = F.pandas_udf(lambda s: s.map(lambda x: min(1.0, 2 * K.normal_sf(abs(x)))), "double")
    found = pairs.select(*keys, "group_a", "group_b", z.alias("z")).withColumn("_p", tail("z"))
    by = W.partitionBy(*keys).orderBy("_p", "group_a", "group_b")
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.row_number().over(by) + 1) * F.col("_p"))
    return found.withColumn("_s", step).select(*keys, "group_a", "group_b", "z", F.max("_s").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("p_value"))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], out: str = "q_value") -> DataFrame:
    """q-values within each family; nulls stay, equal p-values get equal q-values. A family holds one row per test, not per case."""
    ok = F.col(p).isNotNull()
    m = F.count(p).over(W.partitionBy(*family))
    # frames by range: with its peers
    rank = F.count(p).over(W.partitionBy(*family, ok).orderBy(p).rangeBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_r", F.when(ok, F.col(p) * m / F.nullif(rank, F.lit(0))))
    q = F.least(F.lit(1.0), F.min("_r").over(W.partitionBy(*family, ok).orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0)))
    return df.withColumn(out, F.when(ok, q)).drop("_r")


# --- whole tests per facet, in Arrow batches ----------------------------------------------------

HL = "n1 long, n2 long, shift double, low double, high double"


def hodges_lehmann(df: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf.loc[pdf["_1"], "_v"], pdf.loc[~pdf["_1"], "_v"]
        r = K.hodges_lehmann(a, b)
        return pd.DataFrame([[*key, len(a), len(b), r["shift"], r["low"], r["high"]]])

    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(first).alias("_1"), F.col(value).cast("double").alias("_v"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, {HL}" if keys else HL)


def shapiro_wilk(p: Panel, alpha: float = 0.05) -> DataFrame:
    """variable, w, p_value, normal. One task per variable: the test sorts all its values."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = K.shapiro_wilk(pdf["value"])
        return pd.DataFrame([[*key, r["n"], r["w"], r["p_value"], None if r["p_value"] is None else r["p_value"] > alpha]])

    return p.long(p.numeric()).where("value is not null and not isnan(value)").select("variable", "value").groupBy("variable").applyInPandas(run, "variable string, n long, w double, p_value double, normal boolean")


def multivariate_normality(p: Panel) -> DataFrame:
    """Henze-Zirkler over all complete rows. Equal rows count once with their number; the sum over pairs runs block against block, one task a pair of blocks."""
    spark, cols = p.df.sparkSession, p.numeric()
    d = len(cols)
    xs = [f"_x{i}" for i in range(d)]
    rows = p.df.dropna(subset=cols).select(*(F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(cols, xs))).groupBy(*xs).agg(F.count(F.lit(1)).alias("_n"))
    rows = stored(rows, "complete-rows")
    own = rows.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), *(F.sum(F.col(x) * F.col("_n")).alias(x) for x in xs)).collect()[0]
    m, n = own["m"], own["n"]
    sums = []
    if d >= 2 and n > d:
        mean = np.array([own[x] for x in xs]) / n
        off = [F.col(x) - F.lit(float(v)) for x, v in zip(xs, mean)]
        terms = rows.agg(*(F.sum(F.col("_n") * off[i] * off[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).collect()[0]
        cov = np.array([[terms[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / n
        if np.linalg.matrix_rank(cov) == d:
            sums = [_normality_sums(rows, xs, m, mean, np.linalg.pinv(cov), K.henze_zirkler_width(n, d))]
    r = K.henze_zirkler_of(n, d, *(sums[0] if sums else (None, None)))
    return spark.createDataFrame([(r["n"], r["hz"], r["p_value"], r["normal"])], "n long, hz double, p_value double, normal boolean")


def _normality_sums(rows: DataFrame, xs: list[str], m: int, mean: np.ndarray, inv: np.ndarray, b: float) -> tuple[float, float]:
    """Sums over pairs and against the centre of the distinct rows `xs` with their counts _n; every row goes to each pair of blocks with its own."""
    blocks = -(-m // BLOCK_ROWS)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, of = pdf[xs].to_numpy(dtype=float) - mean, pdf["_n"].to_numpy(dtype=float), pdf["_block"].to_numpy()
        low, high = of == key[0], of == key[1]
        pairs = K.henze_zirkler_pairs(x[low], n[low], x[high], n[high], inv, b)
        return pd.DataFrame([[pairs, K.henze_zirkler_centre(x, n, inv, b)] if key[0] == key[1] else [2 * pairs, 0.0]])

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*xs), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sums = dealt.groupBy(F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high")).applyInPandas(run, "pairs double, centre double")
    return tuple(sums.agg(F.sum("pairs"), F.sum("centre")).collect()[0])


# --- co-imperfection ----------------------------------------------------------------------------


def chi2_pairs(p: Panel) -> DataFrame:
    """x, y, n00, n01, n10, n11, chi2 (Yates), cramers_v, p_value for all ordered pairs; null where a mask is constant. One pass for all pairs."""
    each = []
    for a, b in combinations(p.cols, 2):
        ma, mb = p.mask(a), p.mask(b)
        each.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), *(F.count_if((ma == i) & (mb == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1))))
    own = p.df.agg(each_row(each, "x string, y string, n00 bigint, n01 bigint, n10 bigint, n11 bigint").alias("s")).select("s.*")
    t = own.unionByName(own.select(F.col("y").alias("x"), F.col("x").alias("y"), "n00", F.col("n10").alias("n01"), F.col("n01").alias("n10"), "n11"))
    n = (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")).cast("double")
    chi2 = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            e = (F.col(f"n{i}0") + F.col(f"n{i}1")) * (F.col(f"n0{j}") + F.col(f"n1{j}")) / F.nullif(n, F.lit(0.0))
            off = F.abs(F.col(f"n{i}{j}") - e)
            off = off - F.least(F.lit(0.5), off)
            chi2 = chi2 + off * off / F.nullif(e, F.lit(0.0))
    tail = F.pandas_udf(lambda s: s.map(lambda x: None if pd.isna(x) else K.chi2_sf(x, 1)), "double")
    return t.withColumn("chi2", chi2).withColumns({"cramers_v": F.sqrt(F.col("chi2") / F.nullif(n, F.lit(0.0))), "p_value": tail("chi2")})


def rank_biserial_by_lag(p: Panel, lags: int = 10) -> DataFrame:
    """x, y, lag, n1, n0, rank_biserial: y's observed values against x's mask `lag` observed rows earlier, for all ordered pairs.

    One sort by id; a row's masks at all lags travel as one code, not as a row for each lag. A task keeps 2 * `lags` rows of each y, however long an id is.
    """
    ys, width, spark = p.numeric(), len(p.cols), p.df.sparkSession
    xs = {b: [a for a in p.cols if a != b] for b in ys}
    span = list(range(-lags, lags + 1))
    cells = (len(p.cols) - 1) * len(span)
    schema = "x string, y string, lag int, n1 bigint, n0 bigint, rank_biserial double"
    if not ys or not cells:
        return spark.createDataFrame([], schema)
    code = {a: F.when(p.mask(a).isNull(), 0).when(p.mask(a) == 1, R.ONE).otherwise(R.SEEN).cast("tinyint") for a in p.cols}
    value = {b: F.col(b).cast("double") for b in ys}
    found = p.df.agg(*(R.approximate_cuts(value[b]).alias(f"_c{i}") for i, b in enumerate(ys))).collect()[0]  # one row
    cuts = [R.cut_points(x) for x in found]
    rows = p.df.repartition(p.id).sortWithinPartitions(p.id, p.clock, p.clock_no).select(F.col(p.id).alias("_id"), *(code[a].alias(f"_m{i}") for i, a in enumerate(p.cols)), *(value[b].alias(f"_v{i}") for i, b in enumerate(ys)))
    others = [[p.cols.index(a) for a in xs[b]] for b in ys]

    def run(batches):
        held = [_Lagged(width, o, lags) for o in others]
        own = [R.Gathered(i, cells, cuts[i]) for i in range(len(ys))]
        last, number = None, 0
        for batch in batches:
            ids = batch.column(0)
            if not len(ids):
                continue
            after, before = ids.slice(1), ids.slice(0, len(ids) - 1)
            moved = pc.or_(pc.fill_null(pc.not_equal(after, before), False), pc.xor(pc.is_null(after), pc.is_null(before))).to_numpy(zero_copy_only=False)
            no = number + np.cumsum(np.r_[number == 0 or ids[0].as_py() != last, moved])
            last, number = ids[-1].as_py(), int(no[-1])
            codes = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(width)])
            for i, h in enumerate(held):
                v = batch.column(1 + width + i)
                seen = v.is_valid().to_numpy(zero_copy_only=False)
                out = own[i].add(*h.add(no[seen], v.to_numpy(zero_copy_only=False)[seen], codes[:, seen]))
                if out:
                    yield R.batch(out)
        for h, g in zip(held, own):
            out = g.add(*h.add(*h.nothing(), last=True)) + g.deal()
            if out:
                yield R.batch(out)

    o = R.rank_sums(rows.mapInArrow(run, R.DEALT), cells)
    names = spark.createDataFrame([(i, j, a, b, k) for i, b in enumerate(ys) for j, (a, k) in enumerate((a, k) for a in xs[b] for k in span)], "key int, cell int, x string, y string, lag int")
    n1, n = F.col("n1"), F.col("n")
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    return o.join(F.broadcast(names), ["key", "cell"]).select("x", "y", "lag", "n1", (n - n1).alias("n0"), (2 * u / F.nullif((n1 * (n - n1)).cast("double"), F.lit(0.0)) - 1).alias("rank_biserial"))


class _Lagged:
    """A stream of rows in order: each comes out with the others' codes of the rows up to `lags` before and after it within its id."""

    def __init__(self, width: int, others: list[int], lags: int):
        self.width, self.others, self.lags, self.done = width, others, lags, 0
        self.no, self.v, self.codes = self.nothing()

    def nothing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((self.width, 0), dtype=np.int8)

    def add(self, no: np.ndarray, v: np.ndarray, codes: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        no, v, codes = np.r_[self.no, no], np.r_[self.v, v], np.concatenate([self.codes, codes], axis=1)
        lo, hi, k = self.done, len(v) if last else max(self.done, len(v) - self.lags), self.lags
        wide, around = np.pad(no, k, constant_values=-1), np.pad(codes, ((0, 0), (k, k)))
        packed = np.zeros((hi - lo, -(-(2 * k + 1) * len(self.others) // R.CELLS)), dtype=np.int64)
        for j, lag in enumerate(range(-k, k + 1)):
            at = slice(k + lo - lag, k + hi - lag)
            same = wide[at] == no[lo:hi]
            for i, a in enumerate(self.others):
                chunk, shift = divmod(i * (2 * k + 1) + j, R.CELLS)
                packed[:, chunk] |= (around[a, at] * same).astype(np.int64) << (2 * shift)
        keep = max(0, hi - k)
        out = v[lo:hi]
        self.no, self.v, self.codes, self.done = no[keep:], v[keep:], codes[:, keep:], hi - keep
        ranked = ~np.isnan(out)
        return out[ranked], packed[ranked]


def asymmetric_matrix(p: Panel, lags: int = 10) -> DataFrame:
    """x, y, the correlation that is largest in absolute value, its lag (ties: the smallest), and all by lag."""
    c = F.abs("rank_biserial")
    return rank_biserial_by_lag(p, lags).groupBy("x", "y").agg(F.max_by("rank_biserial", F.struct(F.coalesce(c, F.lit(-1.0)), -F.col("lag"))).alias("max_correlation"), F.max_by("lag", F.struct(F.coalesce(c, F.lit(-1.0)), -F.col("lag"))).alias("max_lag"), F.transform(F.array_sort(F.collect_list(F.struct("lag", "rank_biserial"))), lambda s: s["rank_biserial"]).alias("correlations"))


def asymmetric_comparison(p: Panel) -> DataFrame:
    """x, y: y's values where x is imperfect against where it is not: counts, observed counts, Mann-Whitney, and both sides described (mean, sd, quartiles)."""
    each = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (p.mask(a) == 1).alias("first"), F.col(b).cast("double").alias("v")) for a in p.cols for b in p.cols if a != b and p.is_numeric(b)]
    rows = p.df.select(each_row(each, "x string, y string, first boolean, v double").alias("s")).select("s.*").where("first is not null")
    n = rows.groupBy("x", "y").agg(F.count_if("first").alias("n_imperfect"), F.count_if(F.col("first") & F.col("v").isNotNull()).alias("n_imperfect_observed"))
    sides, v = ["x", "y", "first"], F.col("v")
    told = rows.groupBy(*sides).agg(F.stddev_samp(v).alias("sd")).join(quantiles(rows, sides, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75}), sides, "left")
    wide = told.groupBy("x", "y").agg(*(F.max(F.when(F.col("first") == (i == 1), F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("sd", "q25", "median", "q75")))
    return n.join(mann_whitney(rows, ["x", "y"], "v", "first"), ["x", "y"], "left").join(wide, ["x", "y"], "left")


def little_mcar(p: Panel) -> DataFrame:
    """Little's test from one aggregate per pattern; mean and covariance come from complete rows. Driver work is on the pattern table only."""
    cols = p.numeric()
    if len(cols) < 2:
        raise ValueError("the test needs two numeric variables")
    v = [F.col(c).cast("double") for c in cols]
    mom = p.df.dropna(subset=cols).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(v)), *(F.covar_samp(v[i], v[j]).alias(f"c{i}_{j}") for i in range(len(v)) for j in range(i, len(v)))).collect()[0]
    if mom["n"] < len(cols):
        raise ValueError(f"{mom['n']} complete rows are too few for {len(cols)} variables")
    mean = np.array([mom[f"m{i}"] for i in range(len(v))])
    cov = np.array([[mom[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(v))] for i in range(len(v))])
    rows = p.df.groupBy(*(F.col(c).isNull().cast("int").alias(f"k{i}") for i, c in enumerate(cols))).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(v))).collect()  # at most one row per pattern
    own = sorted(((tuple(r[f"k{i}"] for i in range(len(v))), r["n"], [r[f"m{i}"] for i in range(len(v))]) for r in rows), key=lambda x: x[0])
    r = K.little_mcar(own, mean, cov, sum(x[1] for x in own))
    return p.df.sparkSession.createDataFrame([(float(r["statistic"]), int(r["df"]), r["p_value"], r["phi"], r["cramers_v"], int(r["n_patterns"]), int(mom["n"]))], "statistic double, df long, p_value double, phi double, cramers_v double, n_patterns long, n_complete long")


# --- missing at random, or not ------------------------------------------------------------------

#: Normal ranges of vital signs (fixed values).
NORMAL_RANGES = {"heartrate": (51, 90), "resprate": (12, 20), "sbp": (111, 219), "o2sat": (96, 100)}


def severity_rows(p: Panel, ranges: dict[str, tuple[float, float]] = NORMAL_RANGES) -> DataFrame:
    """The rows with {c}_lag1, abnormal_count (values outside their range) and improving_count (values above the previous row's)."""
    df = p.df.withColumns({f"{c}_lag1": F.lag(c).over(p.w) for c in p.cols})
    count = lambda conds: sum((F.when(c, 1).otherwise(0) for c in conds), F.lit(0))
    own = [c for c in p.cols if c in ranges]
    return df.withColumns({"abnormal_count": count([(F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1]) for c in own]), "improving_count": count([F.col(c) - F.col(f"{c}_lag1") > 0 for c in p.cols])})


def impute(df: DataFrame, p: Panel, cols: list[str], strategy: str = "mean") -> DataFrame:
    """zero, mean, median, or the id's last value (then the mean)."""
    if strategy not in ("zero", "mean", "median", "ffill_within_id"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "zero":
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    if strategy == "ffill_within_id":
        df = df.withColumns({c: F.last(c, True).over(p.w) for c in cols})
    if strategy == "median":
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols))).alias("s")).select("s.*")
        fill = {r["c"]: r["m"] for r in quantiles(long, ["c"], "v", {"m": 0.5}).collect()}  # one row a column
    else:
        fill = df.agg(*(F.avg(c).cast("double").alias(c) for c in cols)).collect()[0].asDict()  # one row
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill.get(c) or 0.0))) for c in cols})


def mar_mnar(p: Panel, strategy: str = "mean", standardize: bool = True, ranges: dict[str, tuple[float, float]] = NORMAL_RANGES, c: float = 1e6) -> DataFrame:
    """Per variable a likelihood-ratio test of two logistic models of its missingness: on the others' previous values and severity, without and with its own previous value.

    The rows' previous values are stored once; each pass over them adds up what both models of a variable need.
    """
    out, names = [], p.numeric()
    base = severity_rows(p, ranges).select(*p.keys, *(f"{v}_lag1" for v in names), "abnormal_count", "improving_count", *(F.col(v).isNull().cast("double").alias(f"_y_{v}") for v in names))
    base = stored(base, "severity")
    for v in names:
        rest = [f"{o}_lag1" for o in names if o != v] + ["abnormal_count", "improving_count"]
        own = f"{v}_lag1"
        rows = impute(base.where(F.col(own).isNotNull()), p, [*rest, own], strategy)
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(f"_y_{v}").alias("y"), *(F.avg(x).alias(f"m_{x}") for x in [*rest, own]), *(F.stddev_pop(x).alias(f"s_{x}") for x in [*rest, own])).collect()[0]
        n, y = stats["n"], stats["y"] or 0.0
        if not n or y in (0, n):
            out.append((v, n, int(y), None, None, None, None, None, None, "undefined: one class"))
            continue
        if standardize:
            rows = rows.withColumns({x: (F.col(x) - stats[f"m_{x}"]) / (stats[f"s_{x}"] or 1.0) for x in [*rest, own]})
        rows = rows.select(F.col(f"_y_{v}").alias("label"), *(F.col(x).cast("double") for x in [*rest, own]))
        mar, mnar = logistic(rows, [len(rest), len(rest) + 1], n, y, 1 / c)
        areas = _areas(rows, [mar[1], mnar[1]], n, y)
        lrt = max(0.0, 2 * (mnar[0] - mar[0]))
        p_value = K.chi2_sf(lrt, 1)
        coef = float(mnar[1][-1]) / (stats[f"s_{own}"] or 1.0) if standardize else float(mnar[1][-1])
        out.append((v, n, int(y), lrt, p_value, *areas, coef, 1.0, "MNAR suggested" if p_value < 0.05 else "consistent with MAR"))
    return p.df.sparkSession.createDataFrame(out, "variable string, n long, n_missing long, lrt double, p_value double, auc_mar double, auc_mnar double, own_lag_coefficient double, df double, decision string")


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and a column of ones followed by the features."""
    own = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
    return own[0], np.stack([np.ones(len(own[0])), *own[1:]])


def logistic(rows: DataFrame, widths: list[int], n: int, y: float, penalty: float, rounds: int = 100) -> list[tuple[float, np.ndarray]]:
    """(log-likelihood, intercept and coefficients) of a logistic model of `label` for each width, on the first so many features: the coefficients' squares cost penalty / 2, the intercept's nothing.

    Newton steps, halved where one makes it worse; a pass over the rows serves all models.
    """
    fits = []
    for k in widths:
        b = np.zeros(k + 1)
        b[0] = np.log(y / (n - y))
        fits.append({"at": b, "best": None, "step": None, "done": False})
    cost = np.r_[0.0, np.full(max(widths), penalty)]
    for _ in range(rounds):
        found = _logistic_sums(rows, [f["at"] for f in fits])
        for f, (ll, told, slope, bend) in zip(fits, found):
            if f["done"]:
                continue
            own = cost[: len(f["at"])]
            value = ll - (own * f["at"] ** 2).sum() / 2
            noise = 1e-14 * n + 1e-15 * abs(ll)  # of sums in another order
            if f["best"] is not None and not value >= f["best"][0] - noise:  # not a number either
                f["step"] = f["step"] / 2
                f["at"] = f["best"][2] + f["step"]
                f["done"] = np.abs(f["step"]).max() < 1e-14
                continue
            f["best"] = (value, told, f["at"])
            slope = slope - own * f["at"]
            try:
                f["step"] = np.linalg.solve(bend + np.diag(own), slope)
            except np.linalg.LinAlgError:  # flat for the intercept
                f["step"] = np.linalg.lstsq(bend + np.diag(own), slope, rcond=None)[0]
            if slope @ f["step"] < 1e-10:  # what is left to gain, twice
                f["done"] = True
            else:
                f["at"] = f["at"] + f["step"]
        if all(f["done"] for f in fits):
            break
    return [(float(f["best"][1]), f["best"][2]) for f in fits]


def _logistic_sums(rows: DataFrame, fits: list[np.ndarray]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """For each model its log-likelihood, the same with probabilities at least 1e-12 from 0 and 1, the slope and the negative curvature."""

    def run(batches):
        sums = [np.zeros(2 + len(b) + len(b) ** 2) for b in fits]
        for batch in batches:
            y, x = _columns(batch)
            for s, b in zip(sums, fits):
                own = x[: len(b)]
                z, q = K.logit_parts(b, own)
                kept = np.clip(q, 1e-12, 1 - 1e-12)
                s[0] += (y * z - np.logaddexp(0, z)).sum()
                s[1] += (y * np.log(kept) + (1 - y) * np.log(1 - kept)).sum()
                s[2 : 2 + len(b)] += own @ (y - q)
                s[2 + len(b) :] += ((own * (q * (1 - q))) @ own.T).ravel()
        rows = [(i, j, float(v)) for i, s in enumerate(sums) for j, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], names=["model", "at", "v"])

    out = [np.zeros(2 + len(b) + len(b) ** 2) for b in fits]
    for r in rows.mapInArrow(run, "model int, at int, v double").groupBy("model", "at").agg(F.sum("v").alias("v")).collect():  # some dozens of rows a model
        out[r["model"]][r["at"]] = r["v"]
    return [(s[0], s[1], s[2 : 2 + len(b)], s[2 + len(b) :].reshape(len(b), len(b))) for s, b in zip(out, fits)]


def _areas(rows: DataFrame, fits: list[np.ndarray], n: int, y: float) -> list[float]:
    """The area under each model's ROC curve, by ranks of its probabilities."""
    of = lambda b, x: np.clip(K.logit_parts(b, x)[1], 1e-12, 1 - 1e-12)

    def some(batches):  # every 50th of a batch, in order: cuts may lie anywhere, as results do not depend on them
        for batch in batches:
            _, x = _columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.sort(of(b, x))[::50]) for b in fits], names=[f"q{i}" for i in range(len(fits))])

    found = rows.mapInArrow(some, ", ".join(f"q{i} double" for i in range(len(fits)))).agg(*(R.approximate_cuts(F.col(f"q{i}")) for i in range(len(fits)))).collect()[0]  # one row
    cuts = [R.cut_points(c) for c in found]

    def run(batches):
        own = [R.Gathered(i, 1, cuts[i]) for i in range(len(fits))]
        for batch in batches:
            label, x = _columns(batch)
            codes = np.where(label == 1, R.ONE, R.SEEN).astype(np.int64)[:, None]
            for g, b in zip(own, fits):
                if out := g.add(of(b, x), codes):
                    yield R.batch(out)
        for g in own:
            if out := g.deal():
                yield R.batch(out)

    ranks = {r["key"]: r["ranks"] for r in R.rank_sums(rows.mapInArrow(run, R.DEALT), 1).collect()}  # one row a model
    return [float((ranks[i] - y * (y + 1) / 2) / (y * (n - y))) for i in range(len(fits))]


def missing_rate_by_lag(p: Panel, c: str, parts: int = 10) -> DataFrame:
    """Deciles of the previous value (equal edges merged): n, missing rate and its normal 95 % interval within [0, 1]."""
    rows = p.df.select(F.lag(c).over(p.w).cast("double").alias("v"), F.col(c).isNull().cast("double").alias("m")).where("v is not null")
    edges = quantiles(rows, [], "v", {f"e{i:02d}": i / parts for i in range(1, parts)})
    cuts = edges.select(F.array_distinct(F.array(*(f"e{i:02d}" for i in range(1, parts)))).alias("cuts"))
    b = F.size(F.filter("cuts", lambda e: e < F.col("v")))
    agg = rows.crossJoin(F.broadcast(cuts)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("rate"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    reach = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return agg.withColumns({"low": F.greatest(F.lit(0.0), F.col("rate") - reach), "high": F.least(F.lit(1.0), F.col("rate") + reach)})
