"""Folds by id and how well a score tells two outcomes apart, as aggregates over counted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.expr import ratio
from lacuna.functions.order import ordered_counts, quantiles
from lacuna.operators.strata import assign


def scores(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """keys, n, n_positive, auroc (ties count half), auprc (average precision; equal scores are one threshold), brier. Rows without label or score take no part; null where a class is missing."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*keys, F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    o = ordered_counts(rows, keys, "_s", ["_y"])
    tot = rows.groupBy(*keys).agg(F.sum("_y").alias("_p")) if keys else rows.agg(F.sum("_y").alias("_p"))
    o = o.join(tot, keys) if keys else o.crossJoin(F.broadcast(tot))  # one row
    n, p = F.col("of").cast("double"), F.col("_p").cast("double")
    lost = F.col("n") - F.col("_y")
    above, above_p = F.col("of") - F.col("below"), F.col("_p") - F.col("_y_below")  # at this threshold or higher
    agg = o.groupBy(*keys, "of", "_p").agg(
        F.sum(lost * (F.col("_p") - F.col("_y_below") - F.col("_y") + F.col("_y") / 2.0)).alias("_wins"), F.sum(F.col("_y") * above_p.cast("double") / F.nullif(above, F.lit(0))).alias("_ap"),
        F.sum(F.col("n") * F.col("_s") * F.col("_s") - 2 * F.col("_y") * F.col("_s") + F.col("_y")).alias("_sq"),
    )
    return agg.select(*keys, F.col("of").alias("n"), F.col("_p").cast("bigint").alias("n_positive"), ratio(F.col("_wins"), p * (n - p)).alias("auroc"), F.when(F.col("_p") < F.col("of"), ratio(F.col("_ap"), p)).alias("auprc"), ratio(F.col("_sq"), n).alias("brier"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin (of equal width over 0 to 1), n, mean score, rate."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def folds(df: DataFrame, id_col: str, k: int = 5, fold: Column | None = None) -> DataFrame:
    """Adds `fold`, the same for all rows of an id: by its hash, or as stated."""
    return df.withColumn("fold", (F.pmod(F.xxhash64(id_col), F.lit(k)) if fold is None else fold).cast("int"))


def train_only_strata(df: DataFrame, x: str, y: str, complete: Column | None = None) -> DataFrame:
    """Rows with `fold`, each with the stratum by the medians of the rows of all other folds: nothing of a fold decides its own thresholds."""
    own = df.select("fold").distinct().withColumnRenamed("fold", "_test")  # one row a fold
    train = df.select("fold", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null").join(own, F.col("fold") != F.col("_test"))
    cuts = quantiles(train, ["_test"], "_x", {"threshold_x": 0.5}).join(quantiles(train, ["_test"], "_y", {"threshold_y": 0.5}), "_test").withColumnRenamed("_test", "fold")
    return df.join(cuts, "fold", "left").withColumn("stratum", F.when(F.col("threshold_x").isNotNull(), assign(x, y, F.col("threshold_x"), F.col("threshold_y"), complete)))
