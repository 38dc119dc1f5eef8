"""The library's queries over the driver's tables, each with its SQL in `oracle`.

Panel: events by user with hr (values of click, view and purchase), bp (all but error) and k3 (the number in props, null if a multiple of 7).
Doubles are rounded to 6 digits on both sides; counts are long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators import comparisons as C
from lacuna.operators import cohorts, evaluation, features, gaps, groups, masks, neighbours, resampling, rows, strata, timeline, values
from lacuna.operators import intervals as I
from lacuna.operators.panel import Panel
from lacuna.sources.store import stored

COLS = ["hr", "bp", "k3"]
RANGES = {"hr": (10.0, 90.0), "bp": (None, 95.0)}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).try_cast("int") if hasattr(F.col("x"), "try_cast") else F.expr("try_cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INT)")
    return e.select(
        F.col("user_id").alias("id"), F.col("ts").alias("clock"), "event_type",
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("value")).alias("hr"), F.when(F.col("event_type") != "error", F.col("value")).alias("bp"), F.when(k % 7 != 0, k).alias("k3"),
    )


def panel(spark: SparkSession, sf_dir: str, masked: bool = True) -> Panel:
    p = Panel.of(observations(spark, sf_dir), cols=COLS)
    return masks.missingness(p) if masked else p


def _rounded(x: Column, digits: int = 6) -> Column:
    """As the SQL rounds: the product with the power of ten, halves away from zero. Spark's own rounds the shortest decimal, which differs near halves."""
    y = F.abs(x) * float(10**digits)
    whole = F.floor(F.when(y < 2.0**52, y)).cast("double")
    up = F.when(y - whole >= 0.5, whole + 1.0).otherwise(whole) / float(10**digits)
    up = F.when(y < 2.0**52, up).otherwise(y / float(10**digits))  # these hold no fraction
    return F.when(x.isNull() | F.isnan(x) | (y == float("inf")), x).otherwise(F.when(x < 0, -up).otherwise(up))


def tidy(df: DataFrame) -> DataFrame:
    """Types and rounding of the comparison: doubles to 6 digits (no negative zero), whole numbers long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = _rounded(c.cast("double")) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def _q(f: Callable[[Panel], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(f(panel(spark, sf_dir)))


def _masked(f: Callable[[Panel], Panel]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(masks.mask_frame(f(panel(spark, sf_dir, masked=False))))


def _features(f: Callable[[Panel], Panel], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        p = panel(spark, sf_dir)
        out = f(p)
        new = [c for c in out.df.columns if c not in p.df.columns]
        return tidy(out.df.select("id", "clock_no", *(f"`{c}`" for c in names or new)))

    return run


def _long_groups(p: Panel, k: int) -> DataFrame:
    """bp and hr by case, grouped by id modulo k."""
    m = values.case_metrics(p).select("id", "variable", "value_mean", "value_iqr")
    return groups.tidy({"preliminary": stored(m, "values"), "irregularity": stored(I.case_metrics(I.intervals(p), "id"), "irregularity")}, "id", p.df.select("id", (F.col("id") % k).cast("string").alias("group")))


def _by_level(p: Panel) -> DataFrame:
    """Per-case metrics grouped by how much of a case's first variable is missing: up to a third, up to a half, more."""
    share = F.avg(p.masks()[0].cast("double"))
    level = p.df.groupBy("id").agg(F.when(share <= 1 / 3, "low").when(share <= 0.5, "middle").otherwise("high").alias("group"))
    frames = {"preliminary": values.case_metrics(p).select("id", "variable", "value_mean"), "intravariable": _case_intra(p).select("id", "variable", "indicated_pct", "indicated_centroid")}
    return groups.tidy({k: stored(v, k) for k, v in frames.items()}, "id", level)


def _first(p: Panel) -> DataFrame:
    return p.long(["hr", "bp"]).withColumn("first", F.col("id") % 2 == 0)


def _strata(p: Panel) -> DataFrame:
    m = rows.case_metrics(p)
    axes = strata.Axes("avg_indicated_pct", "breadth", 30.0, 0.9)
    return axes.transform(m, F.col("avg_indicated_pct") == 0).select("id", "stratum", "axis_x", "axis_y", "threshold_x", "threshold_y")


def _strata_fit(p: Panel) -> DataFrame:
    m = stored(I.case_metrics(I.intervals(p), "id"), "irregularity")
    axes = strata.fit(m, ["interval_cv", "interval_qcod", "interval_adh_rate", "interval_entropy"], ("interval_cv", "interval_adh_rate"))
    return axes.transform(m).select("id", "stratum", "axis_x", "axis_y", "threshold_x", "threshold_y", "axis_correlation")


def _case_intra(p: Panel) -> DataFrame:
    return gaps.case_metrics(p, gaps.runs(p))


def _cross(p: Panel) -> DataFrame:
    frames = {"irregularity": I.case_metrics(I.intervals(p), "id"), "intervariable": rows.case_metrics(p), "intravariable": _case_intra(p).select("id", "variable", "indicated_pct")}
    long = groups.tidy({k: stored(v, k) for k, v in frames.items()}, "id")
    return groups.cross_aspect(long)


def _bh(p: Panel) -> DataFrame:
    t = p.long(["hr", "bp"]).groupBy("id", "variable").agg((F.count_if(F.col("mask") == 1) / F.count(F.lit(1))).alias("p_value"))
    return C.benjamini_hochberg(t, "p_value", ["variable"])


def _scored(p: Panel) -> DataFrame:
    """A label (the second variable is missing) and a score between 0 and 1 from the first, with many ties."""
    return p.df.select(p.masks()[1].alias("label"), (F.floor(F.col("k3") % 20) / 20).alias("score"), (F.col("id") % 3).alias("part"))


def _fold_strata(p: Panel) -> DataFrame:
    m = evaluation.folds(rows.case_metrics(p), "id", 5, F.col("id") % 5)
    return evaluation.train_only_strata(m, "avg_indicated_pct", "breadth").select("id", "fold", "stratum", "threshold_x", "threshold_y")


def _stays(p: Panel) -> DataFrame:
    """Purchases as stays of six hours."""
    return p.df.where("event_type = 'purchase'").select("id", F.col("clock").alias("start"), (F.col("clock") + F.expr("INTERVAL 6 HOURS")).alias("end"))


def _events(p: Panel) -> DataFrame:
    return p.df.where("event_type = 'signup'").select("id", "clock")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    iv = lambda f: _q(lambda p: f(I.intervals(p)))
    run = lambda f: _q(lambda p: f(gaps.runs(p)))
    return {
        "mask_missingness": _masked(masks.missingness),
        "mask_range": _masked(lambda p: masks.reference_range(p, RANGES)),
        "mask_iqr_global": _masked(lambda p: masks.plausibility(p, "iqr", 0.6)),
        "mask_iqr_per_id": _masked(lambda p: masks.plausibility(p, "iqr", 0.6, "per_id")),
        "mask_mad_global": _masked(lambda p: masks.plausibility(p, "mad", 1.2, ranges=RANGES)),
        "mask_mad_per_id": _masked(lambda p: masks.plausibility(p, "mad", 1.2, "per_id")),
        "mask_missing_as_flag": _masked(lambda p: masks.plausibility(p, None, missing_as="flag", ranges=RANGES)),
        "mask_missing_as_null": _masked(lambda p: masks.plausibility(p, None, missing_as="null", ranges=RANGES)),
        "mask_long": _q(lambda p: p.long().drop("clock")),
        "mask_matrix": _q(masks.mask_matrix),
        "column_stats": _q(rows.column_statistics),
        "column_stats_per_id": _q(rows.column_statistics_per_id),
        "all_null_rows": _q(rows.all_imperfect_rows),
        "all_null_rows_per_id": _q(rows.all_imperfect_rows_per_id),
        "row_stats": _q(rows.row_statistics),
        "row_stats_per_id": _q(rows.row_statistics_per_id),
        "patterns": _q(rows.patterns),
        "calendar_month": _q(lambda p: timeline.calendar(p, "month")),
        "calendar_weekday": _q(lambda p: timeline.calendar(p, "weekday")),
        "calendar_hour": _q(lambda p: timeline.calendar(p, "hour")),
        "month_hour_grid": _q(timeline.month_hour_grid),
        "intervals": _q(lambda p: I.intervals(p).select("id", "clock_no", "interval_seconds")),
        "interval_case_stats": iv(lambda d: I.case_statistics(d, "id")),
        "interval_global_stats": iv(lambda d: I.describe(d, [], "interval_seconds")),
        "dominant_frequency": iv(I.dominant_frequency),
        "interval_bins": iv(I.bins),
        "interval_entropy_adherence": iv(lambda d: I.entropy_adherence(d, ["id"])),
        "burstiness_case": iv(lambda d: I.burstiness_case(d, "id")),
        "burstiness_global": iv(lambda d: I.burstiness_pooled(d, "id")),
        "interval_acf": _q(lambda p: timeline.acf(I.intervals(p), "id", ["clock", "clock_no"], "interval_seconds")),
        "gap_runs": run(lambda r: r.drop("return_value")),
        "true_gaps": run(gaps.describe_gaps),
        "gap_case_metrics": _q(lambda p: gaps.case_gap_metrics(p, gaps.runs(p))),
        "gap_dominant": run(gaps.dominant_gap),
        "gap_burstiness": run(gaps.gap_burstiness),
        "gap_returns": run(lambda r: gaps.gap_returns(r, "id")),
        "gap_return_bins": run(gaps.return_bin_statistics),
        "markov_counts": _q(timeline.transitions),
        "markov_probs": _q(lambda p: timeline.markov(p).select("variable", "p00", "p01", "p10", "p11", "steady0", "steady1")),
        "markov_p11": _q(timeline.persistence_per_case),
        "acf_mask": _q(lambda p: timeline.acf_masks(p)),
        "acf_value": _q(lambda p: timeline.acf_values(p)),
        "acf_decomposed": _q(lambda p: timeline.decomposed(timeline.acf_values(p), ["variable"], 5)),
        "xcorr_lagged": _q(lambda p: timeline.lagged_cross_correlation(p)),
        "phi_matrix": _q(timeline.phi_matrix),
        "chi2_pairs": _q(lambda p: C.chi2_pairs(p)),
        "conditional_obs": _q(lambda p: neighbours.conditional_observations(p, "hr").drop("clock")),
        "near_imperfect": _q(lambda p: neighbours.values_near(p, "hr", 86400).select("id", "clock", "value", F.size("imperfect_times").alias("n_times"))),
        "near_flags": _q(lambda p: neighbours.near_flags(p, 86400).select("id", "clock_no", "hr_near", "bp_near", "k3_near")),
        "event_mask_nearest": _q(lambda p: neighbours.event_mask(replace(p, df=p.df.where("event_type <> 'signup'")), _events(p)).select("id", "clock", "event")),
        "event_mask_window": _q(lambda p: neighbours.event_mask(p, _events(p), 86400, "before").select("id", "clock", "event")),
        "event_share": _q(lambda p: neighbours.event_share(neighbours.event_mask(p, _events(p), 86400, "both", False))),
        "rank_biserial_lag": _q(lambda p: C.rank_biserial_by_lag(p)),
        "asymmetric_matrix": _q(lambda p: C.asymmetric_matrix(p).select("x", "y", "max_correlation", "max_lag")),
        "asymmetric_comparison": _q(lambda p: C.asymmetric_comparison(p).select("x", "y", "n_imperfect", "n_imperfect_observed", "n1", "n2", "u", *(f"{c}{i}" for i in (1, 2) for c in ("mean", "sd", "q25", "median", "q75")))),
        "case_value_metrics": _q(values.case_metrics),
        "case_intra": _q(_case_intra),
        "case_inter": _q(rows.case_metrics),
        "case_irregularity": _q(lambda p: I.case_metrics(I.intervals(p), "id")),
        "strata_assign": _q(_strata),
        "strata_fit": _q(_strata_fit),
        "axis_corr": _q(lambda p: strata.axis_correlations(rows.case_metrics(p), ["avg_indicated_pct", "co_concentration", "breadth", "pattern_entropy"])),
        "cross_aspect": _q(_cross),
        "describe_groups": _q(lambda p: groups.describe_groups(_long_groups(p, 3))),
        "compare_groups": _q(lambda p: groups.compare_groups(_long_groups(p, 2)).select("aspect", "variable", "metric", "n_groups", "groups", "n_total", "n_defined", "test", "statistic", "effect_size", "skipped_reason")),
        "posthoc_groups": _q(lambda p: groups.posthoc(x := _by_level(p), groups.compare_groups(x))),
        "mwu_u": _q(lambda p: C.mann_whitney(_first(p), ["variable"], "value", "first")),
        "kw_h": _q(lambda p: C.kruskal_wallis(p.long(["hr", "bp"]).withColumn("g", F.col("id") % 3), ["variable"], "value", "g")),
        "cliffs_delta": _q(lambda p: C.cliffs_delta(_first(p), ["variable"], "value", "first")),
        "hodges_lehmann": _q(lambda p: C.hodges_lehmann(values.case_metrics(p).withColumn("first", F.col("id") % 2 == 0), ["variable"], "value_mean", "first")),
        "rank_biserial_interval": _q(lambda p: resampling.rank_biserial_interval(_first(p), ["variable"], "value", "first")),
        "eta_squared_interval": _q(lambda p: resampling.eta_squared_interval(gaps.return_bins(gaps.runs(p)), ["variable"], "return_value", "bin")),
        "bh_qvalues": _q(_bh),
        "t_test": _q(lambda p: C.t_test(_first(p), ["variable"], "value", "first").select("variable", "n1", "n2", "mean_difference", "t", "df", "p_value", "cohens_d")),
        "brown_forsythe": _q(lambda p: C.brown_forsythe(_first(p), ["variable"], "value", "first")),
        "dunn_gap_returns": _q(lambda p: C.dunn(gaps.return_bins(gaps.runs(p)), ["variable"], "return_value", "bin")),
        "histogram": _q(values.histogram),
        "scores": _q(lambda p: evaluation.scores(_scored(p), ["part"], "label", "score")),
        "calibration": _q(lambda p: evaluation.calibration(_scored(p), "label", "score")),
        "fold_strata": _q(_fold_strata),
        "common_ids": _q(lambda p: cohorts.common_ids([p.df.where(F.col("event_type") == e) for e in ("signup", "purchase", "error")], "id")),
        "returns_within": _q(lambda p: cohorts.returns_within(_stays(p), "id", "start", "end", 2 * 86400)),
        "upsample": _q(lambda p: cohorts.upsample(p.df, "id", "clock", ["hr", "bp"], 6 * 3600)),
        "stratum_distribution": _q(lambda p: groups.stratum_distribution(_strata(p).withColumn("label", F.col("id") % 4), "label")),
        "describe_df": _q(values.describe),
        "corr_pairwise_spearman": _q(values.correlation_pairwise),
        "corr_listwise_pearson": _q(values.correlation_listwise),
        "little_mcar": _q(C.little_mcar),
        "shapiro_wilk": _q(C.shapiro_wilk),
        "multivariate_normality": _q(C.multivariate_normality),
        "mar_mnar": _q(C.mar_mnar),
        "missing_rate_by_lag": _q(lambda p: C.missing_rate_by_lag(p, "bp").select("bin", "n", "rate", "low", "high")),
        "severity": _q(lambda p: C.severity_rows(p, {"hr": (51, 90), "bp": (12, 20)}).select("id", "clock_no", "hr_lag1", "bp_lag1", "abnormal_count", "improving_count")),
        "feat_circular": _features(features.circular),
        "feat_lag": _features(lambda p: features.lag_mask(p, 2)),
        "feat_consecutive": _features(features.consecutive),
        "feat_time_since": _features(features.time_since),
        "feat_rolling": _features(lambda p: features.rolling(p, (3,))),
        "feat_ewma": _features(lambda p: features.ewma(p, (0.3,))),
        "feat_interactions": _features(lambda p: features.interactions(p, ["hr", "bp"])),
        "feat_row_pct": _features(features.row_level),
        "feat_interval": _features(features.interval),
        "feat_acceleration": _features(features.acceleration),
        "feat_all": _features(lambda p: features.FeatureGenerator(p).generate_all_features().panel),
    }
