"""Operators on small fixtures with results worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import comparisons as C
from lacuna.operators import features, gaps, masks, neighbours, rows, strata, timeline, values
from lacuna.operators import intervals as I
from lacuna.operators.panel import Panel

N = None
T0 = dt.datetime(2023, 1, 1, 8)


def near(got, want, tol=1e-6):
    assert (got is None) == (want is None), (got, want)
    if want is not None:
        assert abs(got - want) < tol, (got, want)


@pytest.fixture(scope="module")
def f1(spark):
    hr, rr = [70, 72, 74, 999, N, 80, 75, 130, 78], [16, 18, 17, N, N, N, -5, 22, 21]
    data = [(1 + i // 3, 1 + i % 3, f"2023-01-0{1 + i % 3}", hr[i], rr[i]) for i in range(9)]
    return Panel.of(spark.createDataFrame(data, "id int, clock_no int, clock string, heartrate int, resprate int"))


@pytest.fixture(scope="module")
def f2(spark):
    a_hr, b_hr = [70, 72, N, N, 68, 74, 71, N, 69, 73], [65, N, 66, 67, 64, N, N, 63, 68, 65]
    a_bp, b_bp = [120, 118, 122, 119, 121, N, 117, 123, 120, 119], [115, 116, 114, 117, 115, 118, 116, 119, N, 114]
    data = [(p, T0 + dt.timedelta(days=d, seconds=60 * i), float(h) if h else N, float(b) if b else N, i) for p, d, hs, bs in (("A", 0, a_hr, a_bp), ("B", 1, b_hr, b_bp)) for i, (h, b) in enumerate(zip(hs, bs))]
    df = spark.createDataFrame(data, "patient string, time timestamp_ntz, hr double, bp double, clock_no int")
    return masks.missingness(Panel.of(df, "patient", "time"))


def flags(p, c):
    return [r[0] for r in p.df.orderBy(p.id, p.clock_no).select(f"{c}_mask").collect()]


def at(*idx, n=9):
    return [int(i in idx) for i in range(n)]


R = {"heartrate": (0, 300), "resprate": (0, 60)}


@pytest.mark.parametrize(
    "make, hr, rr",
    [
        (masks.missingness, at(4), at(3, 4, 5)),
        (lambda p: masks.reference_range(p, R), at(3), at(6)),
        (lambda p: masks.reference_range(p, R, "flag"), at(3, 4), at(3, 4, 5, 6)),
        (lambda p: masks.plausibility(p), at(3, 7), at(6)),
        (lambda p: masks.plausibility(p, ranges=R), at(3, 7), at(6)),
        (lambda p: masks.plausibility(p, scope="per_id", ranges=R), at(3), at(6)),
        (lambda p: masks.plausibility(p, "mad", 3.5, ranges=R), at(3, 7), at(6)),
    ],
)
def test_masks(f1, make, hr, rr):
    p = make(f1)
    assert flags(p, "heartrate") == hr and flags(p, "resprate") == rr


def test_mask_arguments(f1):
    for bad in ({"method": "x"}, {"scope": "x"}, {"missing_as": "x"}, {"method": None}):
        with pytest.raises(ValueError):
            masks.plausibility(f1, **bad)


def test_missing_as_null_and_non_numeric(spark):
    p = Panel.of(spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, N, N)], "id int, clock int, v double, s string"))
    q = masks.plausibility(p, None, missing_as="null", ranges={"v": (0, 1)})
    assert flags(q, "v") == [1, N] and flags(q, "s") == [0, N]
    assert flags(masks.plausibility(p, None, missing_as="ignore", ranges={"v": (0, 1)}), "s") == [0, 1]


def test_columns_rows_and_gaps(f2):
    got = {r["variable"]: r["indicated_pct"] for r in rows.column_statistics(f2).collect()}
    assert got == {"hr": 30.0, "bp": 10.0}
    r = gaps.true_gaps(gaps.runs(f2))
    lengths = sorted((x["patient"], x["variable"], x["time_length"]) for x in r.collect())
    assert lengths == [("A", "bp", 120), ("A", "hr", 120), ("A", "hr", 180), ("B", "bp", 120), ("B", "hr", 120), ("B", "hr", 180)]
    pct = [x["indicated_vars_pct"] for x in rows.row_statistics(f2).collect()]
    assert sorted(set(pct)) == [0, 50] and pct.count(50) == 8 and sum(pct) / 20 == 20


def test_no_run_before_the_first_or_after_the_last(spark):
    p = masks.missingness(Panel.of(spark.createDataFrame([(1, t, v) for t, v in enumerate([N, 1.0, N, 2.0, N])], "id int, clock int, v double")))
    assert [(r["count_clock_no"], r["time_length"]) for r in gaps.runs(p).collect()] == [(1, 2)]


def test_gap_case_metrics(f2):
    got = {(r["patient"], r["variable"]): r for r in gaps.case_gap_metrics(f2, gaps.runs(f2)).collect()}
    for who in "AB":
        r = got[(who, "hr")]
        near(r["gap_normalized_entropy"], 1.0), near(r["gap_adherence_rate"], 1.0), near(r["max_gap_fraction"], 180 / 540), near(r["gap_missing_centroid"], 12 / 27)
    near(got[("A", "bp")]["gap_normalized_entropy"], 0.0), near(got[("A", "bp")]["gap_missing_centroid"], 5 / 9), near(got[("B", "bp")]["gap_missing_centroid"], 8 / 9)


def test_markov_chi2_phi_acf(f2):
    m = {r["variable"]: r for r in timeline.markov(f2).collect()}["hr"]
    assert [m[f"n{i}{j}"] for i in (0, 1) for j in (0, 1)] == [8, 4, 4, 2]
    near(m["p01"], 1 / 3), near(m["steady1"], 1 / 3)
    c = C.chi2_pairs(f2).where("x = 'hr'").collect()[0]
    assert [c[f"n{i}{j}"] for i in (0, 1) for j in (0, 1)] == [12, 2, 6, 0]
    near(c["chi2"], 0.026455), near(c["cramers_v"], 0.036370)
    near(timeline.phi_matrix(f2).where("x = 'hr' and y = 'bp'").collect()[0]["phi"], -0.218218)
    a = {r["lag"]: r["autocorr"] for r in timeline.acf_masks(f2, 2).where("variable = 'hr'").collect()}
    near(a[1], 0.005026), near(a[2], -0.525893)
    i = {r["patient"]: r for r in rows.case_metrics(f2).collect()}["A"]
    near(i["avg_indicated_pct"], 20), near(i["co_concentration"], 50), near(i["breadth"], 1), near(i["pattern_entropy"], 0.811278), near(i["max_pair_overlap"], 0)


def test_intervals(spark):
    data = {"a": [0, 120, 600, 900, 1200], "b": [0, 300, 600, 900, 1200], "c": [0, 240, 420, 660, 960], "d": [0, 300]}
    p = Panel.of(spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), 1) for k, v in data.items() for s in v], "id string, clock timestamp_ntz, v int"))
    iv = I.intervals(p)
    s = {r["id"]: r for r in I.case_statistics(iv, "id").collect()}
    e = {r["id"]: r for r in I.entropy_adherence(iv, ["id"]).collect()}
    b = {r["id"]: r for r in I.burstiness_case(iv, "id").collect()}
    for k, mean, sd, burst, ent in (("a", 300, 146.969385, -0.342374, 0.946395), ("b", 300, 0, -1, 0), ("c", 240, 48.989795, -0.660958, 0.946395), ("d", 300, N, N, N)):
        near(s[k]["mean_interval"], mean), near(s[k]["std_interval"], sd), near(b[k]["burstiness"], burst), near(e[k]["interval_entropy"], ent), near(s[k]["interval_qcod"], 0)


def test_half_bins_round_to_even_and_modes_break_ties(spark):
    iv = spark.createDataFrame([("a", x) for x in (30, 90, 150, 210)], "id string, interval_seconds long")
    assert {r["bin"]: r["count"] for r in I.bins(iv).collect()} == {0: 1, 2: 2, 4: 1}
    tie = spark.createDataFrame([("a", x) for x in (60, 60, 180, 180)], "id string, interval_seconds long")
    assert I.dominant_frequency(tie).collect()[0]["dominant_interval_seconds"] == 60
    assert I.entropy_adherence(tie, ["id"]).collect()[0]["dominant_interval_seconds"] == 180


def test_sub_second_and_other_clocks(spark):
    p = Panel.of(spark.createDataFrame([(1, T0 + dt.timedelta(milliseconds=ms), 1) for ms in (0, 400, 900, 2100)], "id int, clock timestamp_ntz, v int"))
    assert [r["interval_seconds"] for r in I.intervals(p).collect()] == [1]
    p = Panel.of(spark.createDataFrame([(1, dt.date(2024, 1, d), 1) for d in (1, 2, 4)], "id int, clock date, v int"))
    assert sorted(r["interval_seconds"] for r in I.intervals(p).collect()) == [86400, 172800]
    p = Panel.of(spark.createDataFrame([(1, x, 1) for x in (0.5, 2.0, 2.0)], "id int, clock double, v int"))
    assert [r["interval_seconds"] for r in I.intervals(p).collect()] == [1.5]


def test_strata(spark):
    df = spark.createDataFrame([("x", 0.1, 0.8), ("y", 0.5, 0.4), ("z", 0.9, 0.2)], "id string, interval_cv double, interval_adh_rate double")
    got = {r["id"]: r["stratum"] for r in strata.Axes("interval_cv", "interval_adh_rate", 0.5, 0.5).transform(df).collect()}
    assert got == {"x": "Q_alpha", "y": "Q_gamma", "z": "Q_delta"}
    axes = strata.fit(df, ["interval_cv", "interval_adh_rate"], ("interval_cv", "interval_adh_rate"))
    assert (axes.x_threshold, axes.y_threshold, axes.n) == (0.5, 0.4, 3)
    assert strata.is_inverted("hr_gap_adh_rate") and not strata.is_inverted("xgap_adh_rate")


def test_all_null_rows_and_case_metrics(spark):
    data = [(1, 1, 1, 1, 1), (2, 1, 0, 1, 1), (3, 0, 0, 0, 0), (4, 1, 1, 1, 1), (5, 1, 1, 1, 1), (6, 1, 1, 1, 1), (6, 0, 1, 1, 1)]
    df = spark.createDataFrame([(r[0], k, *(N if m else 1.0 for m in r[1:])) for k, r in enumerate(data)], "id int, clock int, heartrate double, resprate double, o2sat double, sbp double")
    p = masks.missingness(Panel.of(df))
    r = rows.all_imperfect_rows(p).collect()[0]
    assert r["null_rows_count"] == 4
    near(r["null_rows_pct"], 57.142857)
    m = {r["id"]: r for r in rows.case_metrics(p).collect()}
    near(m[6]["avg_indicated_pct"], 87.5), near(m[6]["pattern_entropy"], 1), near(m[6]["max_pair_overlap"], 1), near(m[3]["co_concentration"], N), near(m[3]["pattern_entropy"], N), near(m[3]["max_pair_overlap"], 0)


def test_numeric_clock_markov_and_alternating_acf(spark):
    df = spark.createDataFrame([(k, i, N if b == "1" else 1.0) for k, s in (("a", "10101010"), ("b", "11011011")) for i, b in enumerate(s)], "id string, clock int, vital double")
    m = timeline.markov(masks.missingness(Panel.of(df))).collect()[0]
    assert [m[f"n{i}{j}"] for i in (0, 1) for j in (0, 1)] == [0, 5, 6, 3]
    near(m["steady0"], 0.4)
    alt = spark.createDataFrame([(k, i, N if i % 2 == 0 else 1.0) for k in "ab" for i in range(8)], "id string, clock int, vital double")
    a = [r["autocorr"] for r in timeline.acf_masks(masks.missingness(Panel.of(alt)), 2).orderBy("lag").collect()]
    near(a[0], -0.9375), near(a[1], 0.9375)


def test_lagged_cross_correlation(spark):
    df = spark.createDataFrame([(k, i, N if i % 2 else 1.0, 1.0 if i % 2 else N) for k in "ab" for i in range(3)], "id string, clock int, var1 double, var2 double")
    got = {r["lag"]: r["correlation"] for r in timeline.lagged_cross_correlation(masks.missingness(Panel.of(df)), 1).where("x = 'var1'").collect()}
    near(got[-1], 1), near(got[0], -1), near(got[1], 1)


def test_features(spark):
    t = dt.datetime(2023, 2, 1)
    data = [("a", t + dt.timedelta(seconds=300 * i), v) for i, v in enumerate([1, N, N, 4, 5])]
    p = masks.missingness(Panel.of(spark.createDataFrame(data[::-1], "patient string, time timestamp_ntz, value1 int"), "patient", "time"))
    g = features.FeatureGenerator(p).add_lag_mask().add_consecutive_counts().add_rolling_window_features([2]).add_exponential_moving_average([0.3]).add_time_since().add_interval_features().df.orderBy("clock_no").collect()
    col = lambda c: [r[c] for r in g]
    assert col("value1_mask") == [0, 1, 1, 0, 0] and col("value1_mask_lag_1") == [0, 0, 1, 1, 0] and col("value1_mask_consecutive") == [0, 1, 2, 0, 0]
    assert col("value1_mask_rolling_sum_2") == [0, 1, 2, 1, 0] and col("value1_mask_rolling_var_2") == [0, 0.5, 0, 0.5, 0]
    assert [round(x, 4) for x in col("value1_mask_ewma_0.3")] == [0, 0.3, 0.51, 0.357, 0.2499]
    assert col("value1_time_since_imperfect") == [0, 0, 0, 300, 600] and col("value1_time_since_non_imperfect") == [0, 300, 600, 0, 0]
    assert col("interval_seconds") == [N, 300, 300, 300, 300] and col("interval_z_score") == [N] * 5


def test_ewma_of_many_ids_in_few_partitions(spark):
    df = spark.createDataFrame([(i, k, N if (i + k) % 3 == 0 else 1.0) for i in range(50) for k in range(20)], "id int, clock int, v_mask_a double")
    p = masks.missingness(Panel.of(df))
    got = {(r["id"], r["clock"]): r["v_mask_a_mask_ewma_0.5"] for r in features.ewma(p, (0.5,)).df.collect()}
    for i in range(50):
        y = None
        for k in range(20):
            x = float((i + k) % 3 == 0)
            y = x if y is None else 0.5 * x + 0.5 * y
            near(got[(i, k)], y)


def test_near_and_events(spark):
    t = [T0 + dt.timedelta(seconds=60 * i) for i in range(6)]
    p = masks.missingness(Panel.of(spark.createDataFrame([(1, t[i], v) for i, v in enumerate([1, 2, N, 4, 5, 6])], "id int, clock timestamp_ntz, v int")))
    for where, want in (("both", [1, 2, 4, 5]), ("before", [1, 2]), ("after", [4, 5])):
        got = neighbours.values_near(p, "v", 120, where).collect()
        assert sorted(r["value"] for r in got) == want and all(r["imperfect_times"] == [t[2]] for r in got)
        assert [r["v"] for r in neighbours.near_flags(p, 120, where).where("v_near = 1").orderBy("clock").collect()] == want
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=90))], "id int, clock timestamp_ntz")
    near_ = neighbours.event_mask(p, ev).where("event").orderBy("clock").collect()
    assert [r["clock"] for r in near_] == [t[1], t[2]]  # both as near
    assert [r["clock_no"] for r in neighbours.event_mask(p, ev, 100, "before").where("event").orderBy("clock").collect()] == [1, 2]
    assert neighbours.event_mask(p, ev, 10_000).count() == 0  # every row is at an event
    assert neighbours.event_mask(p, ev, 10_000, remove_ids_without_events=False).count() == 6


def test_case_values_and_constant_guards(spark):
    p = masks.missingness(Panel.of(spark.createDataFrame([(1, T0 + dt.timedelta(hours=i), float(2 * i), 3.0, N) for i in range(4)], "id int, clock timestamp_ntz, a double, k double, e double")))
    r = {x["variable"]: x for x in values.case_metrics(p).collect()}
    near(r["a"]["value_slope"], 2.0), near(r["a"]["value_first"], 0.0), near(r["k"]["value_slope"], 0.0), near(r["e"]["value_mean"], N)
    assert values.correlation_pairwise(p).where("x = 'a' and y = 'k'").collect()[0]["correlation"] is None
    assert C.chi2_pairs(p).where("x = 'a' and y = 'k'").collect()[0]["chi2"] is None
    assert timeline.acf_masks(p, 2).where("variable = 'a'").count() == 0


def test_empty_panel(spark):
    p = masks.missingness(Panel.of(spark.createDataFrame([], "id int, clock timestamp_ntz, a double, b double")))
    for df in (rows.row_statistics(p), gaps.case_gap_metrics(p, gaps.runs(p)), I.case_metrics(I.intervals(p), "id"), rows.case_metrics(p), values.case_metrics(p), features.FeatureGenerator(p).generate_all_features().df, values.correlation_pairwise(p)):
        assert df.where(F.lit(True)).count() in (0, 2)


def test_multivariate_normality_of_all_rows(spark):
    """6,000 complete rows, some equal, in one block and in several, against the sum over all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 2)).round(2) + rng.exponential(size=(6000, 1)).round(1)
    x[:500] = x[0]
    z = x - x.mean(axis=0)
    inv, n, d = np.linalg.inv(z.T @ z / len(z)), len(z), 2
    b2 = (1 / np.sqrt(2) * ((2 * d + 1) / 4) ** (1 / (d + 4)) * n ** (1 / (d + 4))) ** 2
    pairs = sum(np.exp(-b2 / 2 * np.einsum("ij,jk,ik->i", z - r, inv, z - r)).sum() for r in z)
    hz = pairs / n - 2 * np.exp(-b2 / (2 * (1 + b2)) * np.einsum("ij,jk,ik->i", z, inv, z)).sum() / (1 + b2) + n / (1 + 2 * b2)
    p = Panel.of(spark.createDataFrame([(i % 7, i, *map(float, r)) for i, r in enumerate(x)] + [(1, 9999, N, 1.0)], "id int, clock int, u double, v double"))
    for block in (C.BLOCK_ROWS, 1000):
        C.BLOCK_ROWS, old = block, C.BLOCK_ROWS
        r = C.multivariate_normality(p).collect()[0]
        C.BLOCK_ROWS = old
        assert r["n"] == n and not r["normal"]
        near(r["hz"], hz, 1e-6 * hz)
    same = Panel.of(p.df.select("id", "clock", "u", F.col("u").alias("w")))
    assert C.multivariate_normality(same).collect()[0]["hz"] == 4.0 * n


def test_mask_matrix_holds_every_step(spark, tmp_path):
    """The registered query over ids of 3 and 8 events."""
    from lacuna import queries

    data = [(i, T0 + dt.timedelta(days=k), "error" if k % 3 == 2 else "click", 1.0, '{"k": 1}') for i, n in ((1, 3), (2, 8)) for k in range(n)]
    spark.createDataFrame(data, "user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.queries()["mask_matrix"](spark, str(tmp_path))
    assert got.columns == ["id", "variable", *map(str, range(1, 9))]
    rows = {(r["id"], r["variable"]): list(r)[2:] for r in got.collect()}
    assert len(rows) == 6 and rows[(1, "hr")] == [0, 0, 1] + [N] * 5 and rows[(2, "bp")] == [0, 0, 1, 0, 0, 1, 0, 0]


def test_equal_p_values_get_equal_q_values(spark):
    ps = [0.01, 0.04, 0.04, 0.04, 0.04, 0.5, 0.6, 0.9, N]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(ps)] + [("b", 0, 0.2)], "f string, i int, p double")
    got = {(r["f"], r["i"]): r["q_value"] for r in C.benjamini_hochberg(df, "p", ["f"]).collect()}
    for i, q in enumerate([0.064, 0.064, 0.064, 0.064, 0.064, 0.5 * 8 / 6, 0.6 * 8 / 7, 0.9, N]):
        near(got["a", i], q)
    near(got["b", 0], 0.2)


def test_bounds_pass_over_nan(spark):
    nan = float("nan")
    p = Panel.of(spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 5.0, nan, nan])], "id int, clock int, v double"))
    for scope in ("global", "per_id"):
        b = masks.bounds(p, "iqr", 1.5, scope).collect()[0]
        near(b["v_lo"], -1.0)
        near(b["v_hi"], 7.0)


def test_spearman_does_not_depend_on_the_scale(spark):
    for scale in (1e-300, 1e-11, 1.0, 1e200):
        df = spark.createDataFrame([(i * scale, -((i * 7) % 20) * scale) for i in range(20)], "vx double, vy double")
        one = values.spearman(df.withColumn("k", F.lit(1)), ["k"]).collect()[0]
        x, y = np.arange(20), -((np.arange(20) * 7) % 20)
        near(one["correlation"], float(np.corrcoef(x, np.argsort(np.argsort(y)))[0, 1]))


def test_averages_on_a_threshold_do_not_depend_on_row_order(spark):
    """30 of 100 mask cells in rows of every kind: exactly 30 percent."""
    data = [(1, i, *(float(k) if k >= n else N for k in range(10))) for i, n in enumerate([3, 1, 5, 7, 0, 2, 4, 6, 1, 1])]
    p = masks.missingness(Panel.of(spark.createDataFrame(data, "id int, clock int, " + ", ".join(f"v{k} double" for k in range(10)))))
    assert rows.case_metrics(p).collect()[0]["avg_indicated_pct"] == 30.0


def test_median_imputation(spark):
    p = Panel.of(spark.createDataFrame([(1, i, x, N) for i, x in enumerate([1.0, N, 9.0, 3.0])], "id int, clock int, v double, w double"))
    got = C.impute(p.df, p, ["v", "w"], "median").orderBy("clock").collect()
    assert [r["v"] for r in got] == [1.0, 3.0, 9.0, 3.0] and {r["w"] for r in got} == {0.0}
