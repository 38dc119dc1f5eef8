"""The aspects as objects: lazy results by name, chained steps, one run over all of them."""

from __future__ import annotations

import warnings
from copy import copy
from dataclasses import replace
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import comparisons as C
from lacuna.operators import gaps, groups, masks, neighbours, resampling, rows, strata, timeline, values
from lacuna.operators import intervals as I
from lacuna.operators.features import FeatureGenerator
from lacuna.operators.panel import Panel
from lacuna.sources.io import write_csv
from lacuna.sources.store import stored


def _with_interval(tests: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row a variable on both sides."""
    return tests.join(bounds.select("variable", F.col("low").alias("effect_low"), F.col("high").alias("effect_high")), "variable", "left")


class Aspect:
    """results: name to DataFrame, built lazily; save_path writes each as CSV."""

    def __init__(self, panel: Panel, save_path: str | None = None, alpha: float = 0.05):
        self.panel, self.save_path, self.alpha = panel, save_path, alpha
        self.results: dict[str, DataFrame] = {}

    def _set(self, **frames: DataFrame):
        self.results |= frames
        if self.save_path:
            for name, df in frames.items():
                write_csv(df, f"{self.save_path}/{name}")
        return self

    def _steps(self, *steps):
        """All steps; one that fails is reported and left out."""
        for step in steps:
            try:
                step()
            except Exception as e:  # noqa: BLE001
                warnings.warn(f"{type(self).__name__}.{getattr(step, 'func', step).__name__}: {e}")
        return self

    def summary(self) -> DataFrame:
        """name, value rows of the one-row results."""
        parts = []
        for name, df in self.results.items():
            if "variable" not in df.columns and not any(c in df.columns for c in (self.panel.id, "lag", "bin", "x")):
                each = [F.struct(F.lit(f"{name}.{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns]
                parts.append(df.limit(1).select(F.explode(F.array(*each)).alias("s")).select("s.*"))
        out = parts[0] if parts else self.panel.df.sparkSession.createDataFrame([], "name string, value string")
        for x in parts[1:]:
            out = out.unionByName(x)
        return out


class Preliminary(Aspect):
    def describe_df(self):
        return self._set(descriptive_stats=values.describe(self.panel))

    def shapiro_wilk(self):
        return self._set(shapiro_wilk=C.shapiro_wilk(self.panel, self.alpha))

    def multivariate_normality(self):
        return self._set(multivariate_normality=C.multivariate_normality(self.panel))

    def correlation(self, use: str = "listwise"):
        if use not in ("listwise", "pairwise"):
            raise ValueError(f"unknown use {use!r}")
        return self._set(correlation=values.correlation_listwise(self.panel) if use == "listwise" else values.correlation_pairwise(self.panel))

    def autocorrelation(self, lags: int = 20, stl_period: int | None = None):
        found = timeline.acf_values(self.panel, lags)
        return self._set(autocorrelation=found, **({"autocorrelation_stl": timeline.decomposed(found, ["variable"], stl_period)} if stl_period else {}))

    def case_metrics(self, min_obs_spread: int = 2, min_obs_slope: int = 2, slope_time_unit: str = "hour"):
        return self._set(cm_case_metrics=values.case_metrics(self.panel, min_obs_spread, min_obs_slope, slope_time_unit))

    def run(self):
        self.describe_df().multivariate_normality().shapiro_wilk().correlation("pairwise").autocorrelation().case_metrics()
        return self


class Irregularity(Aspect):
    AXES, FALLBACK = ["interval_cv", "interval_qcod", "interval_adh_rate", "interval_entropy"], ("interval_cv", "interval_adh_rate")

    @cached_property
    def intervals(self) -> DataFrame:
        return I.intervals(self.panel)

    def interval_statistics(self):
        return self._set(ins_case_statistics=I.case_statistics(self.intervals, self.panel.id), ins_global_statistics=I.describe(self.intervals, [], "interval_seconds"))

    def dominant_frequency(self, bin_resolution_seconds: float = 60.0, adherence_tolerance: float = 0.5):
        return self._set(domf_frequency_summary=I.dominant_frequency(self.intervals, bin_resolution_seconds, adherence_tolerance), domf_bin_counts=I.bins(self.intervals, bin_resolution_seconds))

    def burstiness(self):
        return self._set(bu_case_burstiness=I.burstiness_case(self.intervals, self.panel.id), bu_global_burstiness=I.burstiness_pooled(self.intervals, self.panel.id))

    def interval_autocorrelation(self, lags: int = 20):
        return self._set(ia_autocorrelation=timeline.acf(self.intervals, self.panel.id, [self.panel.clock, self.panel.clock_no], "interval_seconds", lags))

    def case_entropy_adherence(self, bin_resolution_seconds: float = 60.0, adherence_tolerance: float = 0.5, min_intervals: int = 2):
        return self._set(ea_case_entropy_adherence=I.entropy_adherence(self.intervals, [self.panel.id], bin_resolution_seconds, adherence_tolerance, min_intervals))

    def case_metrics(self, bin_resolution_seconds: float = 60.0, adherence_tolerance: float = 0.5, min_intervals: int = 2, stratify: bool = False):
        m = I.case_metrics(self.intervals, self.panel.id, bin_resolution_seconds, adherence_tolerance, min_intervals)
        if stratify:
            self._set(cm_pairwise_correlations=strata.axis_correlations(m, self.AXES))
            m = strata.fit(m, self.AXES, self.FALLBACK).transform(m)
        return self._set(cm_case_metrics=m)

    def run(self):
        return self._steps(self.interval_statistics, self.dominant_frequency, self.burstiness, self.interval_autocorrelation, self.case_entropy_adherence, self.case_metrics)


class Intravariable(Aspect):
    AXES, FALLBACK = ["indicated_pct", "indicated_centroid", "gap_adh_rate", "gap_entropy"], ("indicated_pct", "gap_entropy")

    @cached_property
    def runs(self) -> DataFrame:
        return gaps.runs(self.panel)

    def column_statistics(self, threshold: float = 5):
        return self._set(cs_overall_statistics=rows.column_statistics(self.panel), cs_case_level_statistics=rows.column_statistics_per_id(self.panel, threshold))

    def gap_statistics(self, bin_resolution_seconds: float = 60.0, adherence_tolerance: float = 0.5):
        return self._set(gs_gaps_observation_runs=self.runs, gs_gaps=gaps.true_gaps(self.runs), gs_gap_summary=gaps.describe_gaps(self.runs), gs_gap_dominant=gaps.dominant_gap(self.runs, bin_resolution_seconds, adherence_tolerance), gs_gap_burstiness=gaps.gap_burstiness(self.runs))

    def gap_returns(self, n_bootstrap: int = 1000):
        binned = gaps.return_bins(self.runs)
        return self._set(gr_gap_returns=gaps.gap_returns(self.runs, self.panel.id), gr_gap_bins=gaps.return_bin_statistics(self.runs), gr_gap_kruskal=_with_interval(C.kruskal_wallis(binned, ["variable"], "return_value", "bin"), resampling.eta_squared_interval(binned, ["variable"], "return_value", "bin", n_bootstrap)))

    def markov_chain_summary(self):
        return self._set(mc_markov_summary=timeline.markov(self.panel), mc_persistence=timeline.persistence_per_case(self.panel))

    def autocorrelation(self, lags: int = 20, stl_period: int | None = None):
        found = timeline.acf_masks(self.panel, lags)
        return self._set(ac_autocorrelation=found, **({"ac_autocorrelation_stl": timeline.decomposed(found, ["variable"], stl_period)} if stl_period else {}))

    def windowed_significance(self, window_seconds: float = 300, window_location: str = "both", n_bootstrap: int = 1000):
        near = neighbours.near_flags(self.panel, window_seconds, window_location)
        each = [F.struct(F.lit(c).alias("variable"), (F.col(f"{c}_near") == 1).alias("near"), F.col(c).cast("double").alias("value")) for c in self.panel.numeric()]
        long = near.select(F.explode(F.array(*each)).alias("s")).select("s.*")
        return self._set(ws_mwu_result=_with_interval(C.mann_whitney(long, ["variable"], "value", "near"), resampling.rank_biserial_interval(long, ["variable"], "value", "near", n_bootstrap)))

    def date_time_statistics(self):
        return self._set(**{f"dt_{k}": timeline.calendar(self.panel, k) for k in ("month", "weekday", "hour")}, dt_month_hour_grid=timeline.month_hour_grid(self.panel))

    def case_metrics(self, bin_resolution_seconds: float = 60.0, adherence_tolerance: float = 0.5, stratify: bool = False):
        m = gaps.case_metrics(self.panel, self.runs, bin_resolution_seconds, adherence_tolerance)
        if stratify:
            parts = []
            for v in self.panel.cols:
                own = m.where(F.col("variable") == v)
                axes = strata.fit(own.where("indicated_pct > 0"), self.AXES, self.FALLBACK, only_discriminating=True)
                parts.append(axes.transform(own, F.col("indicated_pct") == 0))
            out = parts[0]
            for x in parts[1:]:
                out = out.unionByName(x)
            m = out
            if len(self.panel.cols) > 1:
                self._set(cm_cross_variable=self._cross(m))
        return self._set(cm_case_metrics=m)

    def _cross(self, m: DataFrame) -> DataFrame:
        """One row per id with {variable}_{metric} columns and a stratum from two variables' values of one metric."""
        wide = m.groupBy(self.panel.id).pivot("variable", self.panel.cols).agg(*(F.first(a).alias(a) for a in self.AXES))
        names = [f"{v}_{a}" for v in self.panel.cols for a in self.AXES]
        pairs = strata.same_metric_pairs(wide.columns, self.panel.cols, self.AXES)
        return strata.fit(wide, names, pairs[0], pairs).transform(wide, prefix="cv_")

    def run(self):
        return self._steps(self.column_statistics, self.gap_statistics, self.gap_returns, self.markov_chain_summary, self.autocorrelation, self.windowed_significance, self.date_time_statistics)


class Intervariable(Aspect):
    AXES, FALLBACK = ["avg_indicated_pct", "co_concentration", "breadth", "pattern_entropy", "max_pair_overlap"], ("avg_indicated_pct", "breadth")

    def row_statistics(self, analyze_all_null_rows: bool = True):
        self._set(rs_overall_statistics=rows.row_statistics(self.panel), rs_case_level_statistics=rows.row_statistics_per_id(self.panel))
        return self._set(rs_empty_statistics=rows.all_imperfect_rows(self.panel), rs_empty_case_level_statistics=rows.all_imperfect_rows_per_id(self.panel)) if analyze_all_null_rows else self

    def mcar_test(self):
        return self._set(mcar_patterns=rows.patterns(self.panel), mcar_little=C.little_mcar(self.panel))

    def mar_mnar_test(self, impute_strategy: str = "mean", standardize: bool = True):
        return self._set(mar_mnar_results=C.mar_mnar(self.panel, impute_strategy, standardize))

    def symmetric_correlation(self):
        return self._set(sc_symmetric_correlation=timeline.phi_matrix(self.panel), sc_chi2_intervariable_matrix=C.chi2_pairs(self.panel))

    def symmetric_lagged_cross_correlation(self, max_lag: int = 10):
        return self._set(sc_symmetric_crosscorrelation=timeline.lagged_cross_correlation(self.panel, max_lag))

    def asymmetric_correlation(self):
        return self._set(ac_asymmetric_statistical_results=C.asymmetric_comparison(self.panel))

    def asymmetric_lagged_cross_correlation(self, max_lag: int = 10):
        return self._set(ac_asymmetric_crosscorrelation=C.rank_biserial_by_lag(self.panel, max_lag), ac_asymmetric_matrix=C.asymmetric_matrix(self.panel, max_lag))

    def case_metrics(self, stratify: bool = False):
        m = rows.case_metrics(self.panel)
        if stratify:
            self._set(cm_pairwise_correlations=strata.axis_correlations(m, self.AXES))
            m = strata.fit(m.where("avg_indicated_pct > 0"), self.AXES, self.FALLBACK).transform(m, F.col("avg_indicated_pct") == 0)
        return self._set(cm_case_metrics=m)

    def run(self):
        return self._steps(self.row_statistics, self.mcar_test, self.mar_mnar_test, self.symmetric_correlation, self.symmetric_lagged_cross_correlation, self.asymmetric_correlation, self.asymmetric_lagged_cross_correlation)


class Analyzer:
    """All aspects over one panel and one mask."""

    def __init__(self, df: DataFrame, id_col: str = "id", clock_col: str = "clock", clock_no_col: str = "clock_no", cols: list[str] | None = None, imperfection: str = "missingness", plausibility_method: str | None = "iqr", plausibility_threshold: float = 1.5, plausibility_scope: str = "global", plausibility_missing_as: str = "ignore", plausibility_reference_ranges=None, mask_df: DataFrame | None = None, alpha: float = 0.05, save_path: str | None = None, validate: bool = True):
        if imperfection not in ("missingness", "plausibility"):
            raise ValueError(f"unknown imperfection {imperfection!r}")
        p = Panel.of(df.where(F.col(clock_col).isNotNull()), id_col, clock_col, clock_no_col, cols)
        self.bare = p.validated() if validate else p
        self._mask = lambda q, by=(): masks.missingness(q) if imperfection == "missingness" else masks.plausibility(q, plausibility_method, plausibility_threshold, plausibility_scope, plausibility_missing_as, plausibility_reference_ranges, list(by))
        self.panel = masks.custom(self.bare, mask_df) if mask_df is not None else self._mask(self.bare)
        self.alpha = alpha
        self._over(self.panel, save_path)

    def _over(self, panel: Panel, save_path: str | None) -> "Analyzer":
        self.panel, self.save_path = panel, save_path
        at = lambda name: save_path and f"{save_path}/{name}"
        self.preliminary = Preliminary(panel, at("preliminary"), self.alpha)
        self.irregularity = Irregularity(panel, at("irregularity"), self.alpha)
        self.intravariable = Intravariable(panel, at("intravariable"), self.alpha)
        self.intervariable = Intervariable(panel, at("intervariable"), self.alpha)
        self.results: dict[str, DataFrame] = {}
        self.group_results: dict[str, Analyzer] = {}
        return self

    def run(self, cheap_mode: bool = False) -> "Analyzer":
        if not cheap_mode:
            for a in (self.preliminary, self.irregularity, self.intravariable, self.intervariable):
                a.run()
            return self
        self.preliminary.describe_df().correlation("pairwise")
        self.irregularity.interval_statistics()
        self.intravariable.column_statistics().gap_statistics().date_time_statistics()
        self.intervariable.row_statistics().symmetric_correlation()
        self.intervariable._steps(self.intervariable.mcar_test, self.intervariable.mar_mnar_test)
        return self

    def _case_metrics(self, panel: Panel) -> dict[str, DataFrame]:
        """One row per case, or case and variable; stored, as several results start from them."""
        frames = {
            "preliminary": values.case_metrics(panel), "irregularity": I.case_metrics(I.intervals(panel), panel.id),
            "intravariable": gaps.case_metrics(panel, gaps.runs(panel)), "intervariable": rows.case_metrics(panel),
        }
        return {name: stored(df, f"case-{name}") for name, df in frames.items()}

    def run_grouped_analysis(self, annotation_col: str, annotation_df: DataFrame | None = None, top_n_groups: int | None = None, n_bootstrap: int = 1000, analysis_mode: str = "metrics", cheap_mode: bool = False) -> "Analyzer":
        """`metrics`: per-case metrics of every aspect compared between groups; masks with statistical bounds are taken within each group. `full`: every aspect of each group on its own, under group_results by label."""
        if analysis_mode not in ("metrics", "full"):
            raise ValueError(f"unknown analysis_mode {analysis_mode!r}")
        df = groups.annotate(self.bare.df, self.bare.id, annotation_col, annotation_df, top_n_groups)
        cols = [c for c in self.bare.cols if c != annotation_col]
        if analysis_mode == "full":
            return self._each_group(replace(self.bare, df=stored(df, "annotated"), cols=cols), annotation_col, cheap_mode)
        panel = self._mask(replace(self.bare, df=df, cols=cols), (annotation_col,))
        long = groups.tidy(self._case_metrics(panel), panel.id, stored(panel.df.select(panel.id, annotation_col).distinct(), "labels"), annotation_col)
        kept = long.select("group", "id").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("group")
        long = long.join(kept, "group", "left_semi")
        long = stored(long, "groups")
        compared = stored(groups.compare_groups(long, n_bootstrap, self.alpha), "compared")
        self.results |= {"group_comparison_descriptives": groups.describe_groups(long), "group_comparison_results": compared, "group_comparison_posthoc": groups.posthoc(long, compared)}
        return self

    def _each_group(self, bare: Panel, label: str, cheap_mode: bool) -> "Analyzer":
        """One lazy analysis a group, largest first. The labels come to the driver, which makes a set of plans for each: state `top_n_groups` where they are many."""
        sizes = bare.df.groupBy(label).agg(F.count_distinct(bare.id).alias("n")).orderBy(F.desc("n"), label)
        for name in [r[0] for r in sizes.select(label).collect()]:
            own, part = copy(self), replace(bare, df=bare.df.where(F.col(label) == F.lit(name)))
            own.bare = part
            own._over(self._mask(part), self.save_path and f"{self.save_path}/{name}")
            self.group_results[str(name)] = own._run_cheaply() if cheap_mode else own.run()
        return self

    def _run_cheaply(self) -> "Analyzer":
        """The aspects without lags and windows, with per-case metrics and strata."""
        self.preliminary.describe_df().correlation().case_metrics()
        a, b, c = self.intravariable, self.intervariable, self.irregularity
        a._steps(a.column_statistics, a.gap_statistics, a.date_time_statistics, partial(a.case_metrics, stratify=True))
        b._steps(b.row_statistics, b.mcar_test, b.mar_mnar_test, b.symmetric_correlation, partial(b.case_metrics, stratify=True))
        c._steps(partial(c.case_metrics, stratify=True))
        return self

    def cross_aspect_correlation(self, include_observed_values: bool = False, variables: list[str] | None = None, confidence_level: float = 0.95) -> "Analyzer":
        frames = self._case_metrics(self.panel)
        if not include_observed_values:
            frames.pop("preliminary")
        long = groups.tidy(frames, self.panel.id)
        if variables:
            long = long.where(F.col("variable").isin("all", *variables))
        pairs = groups.cross_aspect(long, confidence_level)
        self.results |= {"cross_aspect_correlations": pairs, "cross_aspect_correlation_matrix": groups.correlation_matrix(pairs)}
        return self

    def run_event_based_analysis(self, events_df: DataFrame, event_name_col: str | None = None, included_event_names: list[str] | None = None, window_size: float = 0, window_location: str = "both", remove_ids_without_events: bool = True) -> "Analyzer":
        """Order-free analyses of rows at events and of the others; the segment is a condition on one masked frame."""
        events = neighbours.filter_events(events_df, event_name_col, included_event_names)
        df = neighbours.event_mask(self.panel, events, window_size, window_location, remove_ids_without_events)
        self.results["event_share"] = neighbours.event_share(df)
        for name, cond in (("event", F.col("event")), ("non_event", ~F.col("event"))):
            p = replace(self.panel, df=df.where(cond))
            self.results |= {f"{name}_descriptive_stats": values.describe(p), f"{name}_correlation": values.correlation_pairwise(p), f"{name}_column_statistics": rows.column_statistics(p), f"{name}_row_statistics": rows.row_statistics_per_id(p), f"{name}_patterns": rows.patterns(p), f"{name}_phi": timeline.phi_matrix(p), f"{name}_chi2": C.chi2_pairs(p)}
        return self

    def features(self) -> FeatureGenerator:
        return FeatureGenerator(self.panel)
