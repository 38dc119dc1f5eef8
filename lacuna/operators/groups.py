"""Group comparison and correlation across aspects. Groups are a key of every step, never a loop."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import kernels as K
from lacuna.functions.order import quantiles
from lacuna.operators.comparisons import benjamini_hochberg
from lacuna.operators.values import fisher_interval, rank_correlations

IMPERFECTION, OBSERVED = "imperfection", "observed_values"
FACET = ["aspect", "variable", "metric"]
COMPARISON = (
    "aspect string, variable string, metric string, n_groups long, groups string, n_total long, n_defined long, test string, statistic double, p_value double, effect_size_name string, effect_size double, "
    "effect_low double, effect_high double, shift double, shift_low double, shift_high double, direction string, definedness_p_value double, skipped_reason string"
)
POSTHOC = "aspect string, variable string, metric string, group_a string, group_b string, statistic double, p_value double, delta double, low double, high double"


def annotate(df: DataFrame, id_col: str, label: str, annotations: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """The rows with their id's label (one per id: the smallest), only the `top` labels with most ids; ids without a label go."""
    src = annotations if annotations is not None else df
    labels = src.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("_group"))
    rows = df.drop(label) if annotations is None and label in df.columns else df
    if top:
        best = labels.join(rows.select(id_col).distinct(), id_col, "left_semi").groupBy("_group").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_group").limit(top)
        labels = labels.join(F.broadcast(best.select("_group")), "_group")
    return rows.join(labels.withColumnRenamed("_group", label), id_col)


def tidy(metrics: dict[str, DataFrame], id_col: str, label: DataFrame | None = None, group: str = "group") -> DataFrame:
    """aspect, variable, metric, id, value (and the group by id) from per-case frames."""
    parts = []
    for aspect, df in metrics.items():
        var = F.col("variable") if "variable" in df.columns else F.lit("all")
        cols = [c for c in df.columns if c not in (id_col, "variable")]
        each = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]
        parts.append(df.select(F.lit(aspect).alias("aspect"), var.alias("variable"), F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("s")).select("aspect", "variable", "s.metric", "id", F.when(~F.isnan("s.value"), F.col("s.value")).alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    if label is not None:
        out = out.join(label.select(F.col(id_col).alias("id"), F.col(group).cast("string").alias("group")).distinct(), "id")
    return out


def describe_groups(long: DataFrame) -> DataFrame:
    """Per facet and group: n, n_defined, pct_defined, mean, std, median, q25, q75, min, max and the whiskers (extreme values within 1.5 IQR)."""
    keys = [*FACET, "group"]
    v = F.col("value")
    base = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_defined"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(long, keys, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    whisk = long.where("value is not null").join(q, keys).where(v.between(F.col("q25") - reach, F.col("q75") + reach)).groupBy(*keys).agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    return base.join(q, keys, "left").join(whisk, keys, "left").select(*keys, "n", "n_defined", (F.col("n_defined") * 100 / F.col("n")).alias("pct_defined"), "mean", "std", "median", "q25", "q75", "min", "max", "whisker_low", "whisker_high")


def _compared(key, pdf: pd.DataFrame, n_boot: int) -> pd.DataFrame:
    names = sorted(pdf["group"].unique())
    values = [K.clean(pdf.loc[pdf["group"] == g, "value"]) for g in names]
    sizes = [int((pdf["group"] == g).sum()) for g in names]
    row = dict.fromkeys((x.split()[0] for x in COMPARISON.split(", ")))
    row |= dict(zip(FACET, key)) | {"n_groups": len(names), "groups": ", ".join(names), "n_total": sum(sizes), "n_defined": sum(map(len, values))}
    if len(names) > 1:
        row["definedness_p_value"] = K.chi2_table([[len(v), n - len(v)] for v, n in zip(values, sizes)])["p_value"]
    seen = [v for v in values if len(v)]  # sorted
    if len(names) < 2:
        row["skipped_reason"] = "one group"
    elif min(map(len, values)) < 3:
        row["skipped_reason"] = "fewer than 3 defined values in a group"
    elif min(v[0] for v in seen) == max(v[-1] for v in seen):
        row["skipped_reason"] = "no variation"
    elif len(names) == 2:
        a, b = values
        m, c, h = K.mann_whitney(a, b), K.cliffs_delta(a, b), K.hodges_lehmann(a, b)
        row |= {"test": "Mann-Whitney", "statistic": m["u"], "p_value": m["p_value"], "effect_size_name": "Cliff's delta", "effect_size": c["delta"], "effect_low": c["low"], "effect_high": c["high"], "shift": h["shift"], "shift_low": h["low"], "shift_high": h["high"], "direction": f"{names[0]} {'>' if c['delta'] > 0 else '<' if c['delta'] < 0 else '='} {names[1]}"}
    else:
        k = K.kruskal(values)
        low, high = K.bootstrap(values, lambda g: K.kruskal(g)["eta_squared"], n_boot)
        row |= {"test": "Kruskal-Wallis", "statistic": k["h"], "p_value": k["p_value"], "effect_size_name": "eta squared", "effect_size": k["eta_squared"], "effect_low": low, "effect_high": high}
    return pd.DataFrame([row])


def compare_groups(long: DataFrame, n_boot: int = 1000, alpha: float = 0.05) -> DataFrame:
    """One row per facet, with q-values within the families of imperfection and of observed values."""
    found = long.groupBy(*FACET).applyInPandas(lambda key, pdf: _compared(key, pdf, n_boot), COMPARISON)
    found = found.withColumn("family", F.when(F.col("aspect") == "preliminary", OBSERVED).otherwise(IMPERFECTION))
    found = benjamini_hochberg(found, "p_value", ["family"], "q_value")
    found = benjamini_hochberg(found, "definedness_p_value", ["family"], "definedness_q_value")
    return found.withColumn("significant", F.col("q_value") < alpha)


def posthoc(long: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairwise tests with effect sizes for facets with more than two groups that differ."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {g: K.clean(x["value"]) for g, x in pdf.groupby("group")}
        names = sorted(g for g, v in groups.items() if len(v) >= 3)
        rows = []
        for i, j, s, p in K.dscf([groups[g] for g in names]):
            c = K.cliffs_delta(groups[names[i]], groups[names[j]])
            rows.append([*key, names[i], names[j], s, p, c["delta"], c["low"], c["high"]])
        return pd.DataFrame(rows, columns=[x.split()[0] for x in POSTHOC.split(", ")])

    gate = compared.where("n_groups > 2 and significant").select(*FACET)
    return long.join(gate, FACET, "left_semi").groupBy(*FACET).applyInPandas(run, POSTHOC)


def axis_names(long: DataFrame) -> DataFrame:
    """axis (variable_metric, or the metric alone for case-wide ones; with the aspect where two aspects share it), aspect, id, value."""
    name = F.when(F.col("variable") == "all", F.col("metric")).otherwise(F.concat_ws("_", "variable", "metric"))
    rows = long.select("aspect", name.alias("axis"), "id", "value")
    shared = rows.select("aspect", "axis").distinct().groupBy("axis").agg(F.count(F.lit(1)).alias("_k"))
    return rows.join(F.broadcast(shared), "axis").select(F.when(F.col("_k") > 1, F.concat_ws("_", "aspect", "axis")).otherwise(F.col("axis")).alias("axis"), "aspect", "id", "value")


def cross_aspect(long: DataFrame, confidence: float = 0.95) -> DataFrame:
    """axis_x, axis_y, aspects, kind (within or cross), n, correlation (Spearman), interval; largest absolute correlation first, undefined last.

    Axes are few: each id's values form one row, from which all pairs are ranked at once.
    """
    axes = axis_names(long).where("value is not null").persist()  # one row per case and axis
    known = [(r["axis"], r["aspect"]) for r in axes.select("axis", "aspect").distinct().orderBy("axis").collect()]  # one row per axis
    names = [a for a, _ in known]
    wide = axes.groupBy("id").pivot("axis", names).agg(F.first("value"))
    of, schema = dict(known), "axis_x string, axis_y string, n bigint, correlation double, aspect_x string, aspect_y string"
    rho = long.sparkSession.createDataFrame([(*x, of[x[0]], of[x[1]]) for x in rank_correlations(wide, list(combinations(names, 2)))], schema)
    axes.unpersist()
    low, high = fisher_interval(F.col("correlation"), F.col("n"), K.normal_ppf(0.5 + confidence / 2))
    kind = F.when(F.col("aspect_x") == F.col("aspect_y"), "within").otherwise("cross")
    return rho.select("axis_x", "axis_y", "aspect_x", "aspect_y", kind.alias("kind"), "n", "correlation", low.alias("low"), high.alias("high")).orderBy(F.desc_nulls_last(F.abs("correlation")), "axis_x", "axis_y")


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    both = pairs.select("axis_x", "axis_y", "correlation").unionByName(pairs.select(F.col("axis_y").alias("axis_x"), F.col("axis_x").alias("axis_y"), "correlation"))
    same = both.select("axis_x").distinct().select("axis_x", F.col("axis_x").alias("axis_y"), F.lit(1.0).alias("correlation"))
    return both.unionByName(same).groupBy("axis_x").pivot("axis_y").agg(F.first("correlation"))


def stratum_distribution(strata: DataFrame, label: str) -> DataFrame:
    """Cases per label and stratum, with their share of the label."""
    n = strata.groupBy(label, "stratum").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(label)))
